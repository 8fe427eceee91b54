"""Near copies by SimHash, and at a given Jaccard similarity of word shingles through MinHash bands.

Given a number of bits, rows whose operator-6 fingerprints differ in as many or fewer are linked,
all of them (``simhash.near_pairs``). Such fingerprints miss most pairs at a similarity of 0.8, which
differ in some ten of 64 bits, so the links by similarity are taken too; a group is what both connect.

Candidates must depend on the similarity alone, not on where two texts differ or how often they
repeat a passage. Each document's shingle set gives ``BANDS`` keys of ``ROWS`` minimum hashes; two
sets share a key with probability 1 - (1 - J**ROWS)**BANDS, which is 0.999995 at J = 0.8 and more
above. All candidates whose set sizes allow the similarity are verified by the exact Jaccard
similarity of their shingle sets.

A group of copies must not become all its pairs. Rows with equal sets are one node from the start.
Each key's nodes are then compared with one of them only; components of these links are taken; and
a second round compares all pairs of a key that lie in different components, so no link between
components is lost. Choosing other nodes of a key in more rounds in between left as many pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoflow.llm import _bloom
from kairoflow.llm._batches import slices, two_columns
from kairoflow.llm._components import connected_components
from kairoflow.llm._words import LOWER, SPACE, Words, mix
from kairoflow.llm.simhash import fingerprints, near_pairs
from kairoflow.session import discard, materialize, ship

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(part: pa.RecordBatch, width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; fewer words: all of them are the one."""
    words = Words(part, member=~SPACE)
    hashes = words.hashes(LOWER)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(words.firsts[:-1], words.firsts[1:]):
            own, n = hashes[a:b], max(1, b - a - width + 1)
            key = np.full(n, min(width, b - a), np.uint64)
            for j in range(min(width, b - a)):
                key = mix((key ^ own[j : j + n]) * _PRIME)
            out.append(np.unique(key))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) keys: of each band its number and ROWS minimum hashes of the text's shingles."""
    sizes = np.array([len(x) for x in sets])
    flat, firsts = np.concatenate(sets), np.cumsum(sizes) - sizes
    salts = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    hashed, out = np.empty_like(flat), np.empty((len(sets), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sets), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.bitwise_xor(flat, salts[2 * k], out=hashed)
                np.multiply(hashed, salts[2 * k + 1] | np.uint64(1), out=hashed)
                key = mix((key ^ np.minimum.reduceat(hashed, firsts)) * _PRIME)
            out[:, band] = key
    return out


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, 2) words of 64 bits that name a set: sums of two independent hashes of its members."""
    sizes = np.array([len(x) for x in sets])
    flat, firsts = np.concatenate(sets), np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix(flat * _PRIME + np.uint64(salt)), firsts) for salt in (1, 2)], 1)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, sig) of the rows with a doc_id; sig tells rows apart that repeat one."""
    return two_columns(docs, doc_id, text).where("doc_id is not null").withColumn("sig", F.xxhash64("doc_id", "text"))


def _sketches(docs: DataFrame, doc_id: str, text: str, width: int, prints: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, operator="near_dups"):
            sets = shingles(part, width)
            keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(band_keys(sets).view(np.int64).ravel()))
            name = set_digests(sets).view(np.int64)
            sizes = pa.array([len(x) for x in sets], pa.int32())
            fps = pa.array(fingerprints(part).view(np.int64)) if prints else pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), fps, sizes, keys], ["doc_id", "sig", "h1", "h2", "fp", "n", "keys"])

    return _keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, sig long, h1 long, h2 long, fp long, n int, keys array<long>")


def _grams(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(node, grams) of the nodes in ``wanted`` (node, doc_id, sig), read from one row of each."""
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(_bloom.build(wanted.select(F.col("sig").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, operator="near_dups"):
            at = _bloom.may_hold(bloom.value, part.column(2).to_numpy().view(np.uint64))
            if len(at):
                part = part.take(pa.array(at))
                sets = [x.view(np.int64) for x in shingles(part, width)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sig", "grams"])

    found = _keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, sig long, grams array<long>")
    return found.join(wanted, ["doc_id", "sig"]).dropDuplicates(["node"]).select("node", "grams")


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingles reach the similarity, row by row in the JVM."""
    u = pairs.join(grams.select(F.col("node").alias("u"), F.col("grams").alias("_a")), "u")
    both = u.join(grams.select(F.col("node").alias("v"), F.col("grams").alias("_b")), "v")
    shared = F.size(F.array_intersect("_a", "_b"))
    return materialize(both.where(shared >= F.lit(similarity) * (F.size("_a") + F.size("_b") - shared)).select("u", "v"), "linked")


def _fits(n: str, m: str, similarity: float):
    """The smaller set's share of the larger bounds the similarity."""
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)


def _links(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    """(u, v): enough of the links between nodes to have their components."""
    own = nodes.select(F.explode("keys").alias("key"), "node", "n")
    # Keys of one node meet nothing.
    leaders = own.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l"), F.count("*").alias("members")).where("members > 1")
    leaders = materialize(leaders.select("key", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
    places = materialize(own.join(leaders, "key"), "places")
    discard(leaders)
    wanted = materialize(places.select("node").distinct().join(nodes.select("node", "doc_id", "sig"), "node"), "wanted")
    grams = materialize(_grams(docs, wanted, doc_id, text, width), "grams")
    star = places.where(F.col("node") != F.col("leader")).where(_fits("n", "leader_n", similarity)).select(F.col("leader").alias("u"), F.col("node").alias("v"))
    links = _verified(star.distinct(), grams, similarity)
    parts = materialize(connected_components(links), "parts")
    named = places.select("key", "node", "n").join(parts.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    named = materialize(named, "named")
    # Keys with several components, and that of one of their nodes by a hash: in a large group mostly the largest.
    pick = F.min(F.struct(F.xxhash64("node").alias("h"), "c"))
    several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), pick.alias("l")).where("lo <> hi").select("key", F.col("l.c").alias("main"))
    met = materialize(named.join(several, "key"), "met")
    # Of two nodes in different components, one at least isn't in the main one: those meet all others of the key.
    left = met.where("c <> main").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    right = met.select("key", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), "main")
    # Where neither is in it, the pair is met from both sides: once is enough.
    pairs = left.join(right, "key").where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & _fits("nx", "ny", similarity))
    more = _verified(pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), grams, similarity)
    links, before = materialize(links.unionByName(more), "links"), links
    for table in (before, more, parts, named, met):
        discard(table)
    for table in (places, wanted, grams):
        discard(table)
    return links


def _simhash_links(rows: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """(u, v): enough of the links between nodes with fingerprints at ``bits`` or fewer differing bits."""
    own = rows.select("fp", "h1", "h2").distinct().join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).select("fp", "node")
    own = materialize(own, "prints")
    # A fingerprint's nodes are linked to the least of them, which stands for the fingerprint.
    heads = materialize(own.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("members")), "heads")
    same = own.join(heads.where("members > 1"), "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    near = near_pairs(heads.select("fp"), bits).withColumnsRenamed({"u": "x", "v": "y"})
    near = near.join(heads.select(F.col("fp").alias("x"), F.col("head").alias("u")), "x").join(heads.select(F.col("fp").alias("y"), F.col("head").alias("v")), "y")
    links = materialize(same.unionByName(near.where("u <> v").select("u", "v")), "near")
    for table in (own, heads):
        discard(table)
    return links


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, bits: int | None = None) -> DataFrame:
    """(doc_id, sig, component_id, kept): the rows that have a near copy or an equal.

    Near copies are rows at ``similarity`` or more and, where ``bits`` (0 to 2) is given, also those
    whose SimHash fingerprints, as operator 6 has them, differ in ``bits`` or fewer.

    component_id is the least doc_id of the group; kept is true for the one row of the group that
    stays, that of the least (doc_id, sig), sig being ``xxhash64(doc_id, text)``. Words are runs
    without white space, A-Z lower-cased. Null and empty texts count as texts without words, which
    are copies of each other. Rows that repeat doc_id and text are one row; rows that repeat a
    doc_id with other texts are told apart; rows without a doc_id are in no group. Very long texts
    only have larger sets. An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = materialize(_sketches(docs, doc_id, text, width, bits is not None), "sketches")
    # A node is a distinct shingle set; its number is written before it is used.
    first = F.min(F.struct("doc_id", "sig"))
    nodes = rows.groupBy("h1", "h2").agg(first.alias("f"), F.max(F.struct("doc_id", "sig")).alias("t"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "f.doc_id", "f.sig", (F.col("f") != F.col("t")).alias("shared"), "n", "keys"), "nodes")
    links = _links(nodes, docs, doc_id, text, width, similarity)
    if bits is not None:
        prints = _simhash_links(rows, nodes, bits)
        both = materialize(links.unionByName(prints), "both")
        discard(links)
        discard(prints)
        links = both
    parts = connected_components(links).withColumnRenamed("component", "c")
    named = nodes.select("node", "h1", "h2", "doc_id", "sig", "shared").join(parts, "node", "left").where(F.col("c").isNotNull() | F.col("shared")).withColumn("c", F.coalesce("c", "node"))
    named = materialize(named, "named")
    keepers = named.groupBy("c").agg(F.min(F.struct("doc_id", "sig")).alias("keeper"))
    whole = materialize(named.join(keepers, "c").select("h1", "h2", "keeper"), "whole")
    members = rows.select("doc_id", "sig", "h1", "h2").join(whole, ["h1", "h2"])
    kept = (F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("sig") == F.col("keeper.sig"))
    groups = materialize(members.select("doc_id", "sig", F.col("keeper.doc_id").alias("component_id"), kept.alias("kept")).distinct(), "groups")
    for table in (rows, nodes, links, named, whole):
        discard(table)
    return groups


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies alone, as ``near_groups`` defines it; rows
    that repeat that row's doc_id and text stay beside it. All columns as they are."""
    gone = near_groups(docs, doc_id, text, bits=bits).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("sig").alias("_gone_sig"))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    sig = F.xxhash64(docs[doc_id].cast("long"), body)
    return docs.join(gone, (docs[doc_id].cast("long") == gone["_gone_id"]) & (sig == gone["_gone_sig"]), "left_anti")
