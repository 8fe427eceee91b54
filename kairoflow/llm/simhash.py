"""SimHash near duplicates by multi-index hashing.

A fingerprint is cut into 32-bit segments. Two fingerprints of 64 bits that differ in at most two
bits have either first segments that differ in at most one bit, or equal second segments. So the
first segment is looked up with every word of its Hamming ball of radius one (only by fingerprints
whose segment has an even number of ones: a single flip changes the parity, so the pair is still
met from one side), the second as it is; complete distances are then verified. Equal fingerprints
are collapsed before, so a group of copies of any size is one node.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.llm._batches import slices, text_buffers, two_columns
from kairoflow.llm._components import connected_components
from kairoflow.session import materialize, ship

SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Shingles whose bits are counted at once.
_STEP = 1 << 16


def normalised(part: pa.RecordBatch, column: int = 1) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, word starts, word ends, words per text): A-Z lower-cased, words parted by one
    space each; words never cross texts."""
    data, offsets = text_buffers(part.column(column))
    low = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    # A word's bytes up to the next space or text end; then one space.
    word = np.cumsum(first)[inside] - 1
    size = np.bincount(word, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    out = np.full(int(size.sum() + len(starts)), 32, np.uint8)
    out[np.arange(len(word)) + word] = low[inside]
    return out.tobytes(), begins, begins + size, counts


def fingerprints(part: pa.RecordBatch, width: int = 3, column: int = 1) -> np.ndarray:
    """64-bit SimHash of each text over the XXH64 (seed 42) of its word shingles, repeats included.

    Fewer words than ``width``: the whole sequence is the one shingle; no word: zero.
    """
    joined, begins, ends, counts = normalised(part, column)
    hashes, each = [], np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    digest, at = xxhash.xxh64_intdigest, 0
    firsts = np.concatenate([[0], np.cumsum(counts)])
    heads = np.repeat(firsts[:-1], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    tails = np.minimum(heads + width, np.repeat(firsts[1:], each)) - 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[heads].tolist(), ends[tails].tolist())), np.uint64, len(heads))
    ones = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), each)
    for at in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[at : at + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[at : at + _STEP]
        cut = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > each[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row: doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part, width).view(np.int64))], ["doc_id", "fp"])

    return two_columns(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long")


def near_pairs(prints: DataFrame, most: int = 2) -> DataFrame:
    """(u, v): pairs of distinct fingerprints (column fp, no repeats) at ``most`` (0 to 2) differing bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    even = F.bit_count(high) % 2 == 0
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    table = lambda segment, key: F.struct(F.lit(segment).alias("segment"), key.alias("key"))
    stored = prints.select("fp", F.explode(F.array(table(0, high), table(1, low))).alias("at")).select("at.*", F.col("fp").alias("v"))
    own = F.array(table(0, high), table(1, low))
    balls = F.when(even, F.transform(flips, lambda key: table(0, key))).otherwise(F.array().cast("array<struct<segment:int,key:bigint>>"))
    probes = prints.select("fp", F.explode(F.concat(own, balls)).alias("at")).select("at.*", F.col("fp").alias("u"))
    # A probe of the ball meets only segments of odd parity, so no pair is met from both sides there.
    met = probes.join(stored, ["segment", "key"])
    near = met.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most))
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id reachable over fingerprints at ``most`` or fewer differing
    bits, itself included; n_links counts the different fingerprints linked to the row's own. Texts
    without words have fingerprint zero and are linked like any other. Rows with a null doc_id get
    the smallest known id of their component (null if it has none). Repeated rows share a
    component. An empty table gives no rows; other columns aren't read.
    """
    prints = materialize(simhash(docs, doc_id, text, width), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    edges = materialize(near_pairs(nodes.select("fp"), most), "near")
    parts = connected_components(edges).withColumnRenamed("node", "fp")
    links = edges.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    whole = named.join(roots, "component").join(links, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return prints.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")
