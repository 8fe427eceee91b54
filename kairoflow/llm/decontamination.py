"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of at most nine words hash six of them and ignore the rest. They were chosen by
enumeration: wherever the changed words of an overlap stand, at least one mask has a place that
meets unchanged words alone. Hashes of
benchmark items and documents are joined; around each hit the two are compared word by word on
the hit's diagonal.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.llm import _bloom
from kairoflow.llm._batches import slices, two_columns
from kairoflow.llm._words import Words, mix
from kairoflow.session import materialize, ship

#: Any two changes in 13 words and any fifth of an item of 12 to 23 words leave one of these whole;
#: a longer item is made of such pieces, one of which has no more than a fifth of its words changed.
MASKS = ("1101111", "111010011", "111111", "1111011", "111010101")
#: Items with fewer words have masks of their own length.
SPAN = 12
#: Items with fewer words can't be told from ordinary text; they are not searched for.
MIN_WORDS = 5
#: An overlap: this many words in a row of which at most ``WINDOW - AGREE`` differ, or this share of an item.
WINDOW, AGREE, SHARE = 13, 11, 0.8


def _keys(hashes: np.ndarray, places: list[int], salt: int) -> np.ndarray:
    """One key for each start; places are the offsets a mask looks at."""
    n = max(0, len(hashes) - max(places))
    key = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for j in places:
            key = (key ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return mix(key)


def _seeds(lengths: list[int]) -> list[tuple[int | None, int, list[int]]]:
    """(None, 0, places) of the masks, and (length, first place, places from there) for each length
    of items under ``SPAN`` words: cut into parts, with one (two, from 10 words on) left out in turn,
    so that any fifth of the words may be changed."""
    masks: list[tuple[int | None, int, list[int]]] = [(None, 0, [i for i, c in enumerate(mask) if c == "1"]) for mask in MASKS]
    for n in sorted(lengths):
        changes = n - math.ceil(SHARE * n - 1e-9)
        parts = [list(x) for x in np.array_split(np.arange(n), 2 * changes + (changes == 1))] if changes else [list(range(n))]
        for left_out in itertools.combinations(range(len(parts)), changes):
            places = [int(i) for k, part in enumerate(parts) if k not in left_out for i in part]
            masks.append((n, places[0], [i - places[0] for i in places]))
    return masks


def _item_rows(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part)
            hashes, out = words.hashes(), {"item_id": [], "tokens": [], "keys": []}
            for i, item in enumerate(part.column(0).to_pylist()):
                own = hashes[words.firsts[i] : words.firsts[i + 1]]
                if len(own) < MIN_WORDS:
                    continue
                keys = []
                for salt, (length, first, places) in enumerate(_seeds(lengths)):
                    made = _keys(own, places, salt).view(np.int64)
                    if length is None and len(own) >= SPAN:
                        keys += [{"key": int(k), "pos": p} for p, k in enumerate(made)]
                    elif len(own) == length:
                        keys.append({"key": int(made[first]), "pos": first})
                out["item_id"].append(item)
                out["tokens"].append(own.view(np.int64))
                out["keys"].append(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item_id"], pa.int64()), pa.array(out["tokens"], pa.list_(pa.int64())), pa.array(out["keys"], pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())])))],
                ["item_id", "tokens", "keys"],
            )

    return run


def _document_rows(lengths: list[int], around: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, kind = _seeds(lengths), pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())]))
        for part in slices(batches):
            words = Words(part)
            hashes, owner = words.hashes(), words.owner
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for salt, (_, _, places) in enumerate(seeds):
                keys = _keys(hashes, places, salt)
                at = _bloom.may_hold(bloom.value, keys)
                at = at[owner[at] == owner[at + max(places)]]
                found.append((at, keys[at]))
            at = np.concatenate([x for x, _ in found])
            keys = np.concatenate([x for _, x in found]).view(np.int64)
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            ids, base, tokens, hits = [], [], [], []
            if len(at):
                # Hits close to each other in one text share a piece of context.
                cut = np.flatnonzero((np.diff(at) > around) | (np.diff(owner[at]) != 0)) + 1
                doc_ids = part.column(0)
                for a, b in zip([0, *cut], [*cut, len(at)]):
                    text = owner[at[a]]
                    low = max(words.firsts[text], at[a] - around)
                    high = min(words.firsts[text + 1], at[b - 1] + around)
                    ids.append(doc_ids[int(text)].as_py())
                    base.append(int(low))
                    tokens.append(hashes[low:high].view(np.int64))
                    hits.append([{"key": int(k), "pos": int(p - low)} for k, p in zip(keys[a:b], at[a:b])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(hits, kind)], ["doc_id", "tokens", "hits"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the diagonals on which the words agree: (doc_id, item_id, matched, item_words)."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            doc, item, shift = np.array(row["tokens"], np.int64), np.array(row["item_tokens"], np.int64), row["shift"]
            low, high = max(0, -shift), min(len(item), len(doc) - shift)
            same = doc[low + shift : high + shift] == item[low:high]
            total = np.concatenate([[0], np.cumsum(same)])
            window = int((total[WINDOW:] - total[:-WINDOW]).max()) if len(same) >= WINDOW else 0
            if total[-1] >= SHARE * len(item) - 1e-9 or window >= AGREE:
                rows.append((row["doc_id"], row["item_id"], int(total[-1]), len(item)))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "matched", "item_words"])


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (doc_id, item_id) whose words overlap: matched (words that agree on the best
    diagonal), item_words.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. An overlap is 11 of 13
    words in a row, or 80 % of an item's words in place; both are judged over the item's whole length
    and both are found wherever the changed words stand. Items under 5 words are not searched for.
    Null and empty texts overlap with nothing; rows with a null id are reported under null; rows
    that repeat an id count as one document; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    source = two_columns(items.withColumnRenamed(item_id, "_item_id"), "_item_id", item_text)
    short = F.when((F.col("n") >= MIN_WORDS) & (F.col("n") < SPAN), F.col("n"))
    sizes = source.mapInArrow(_item_sizes, "n int").agg(F.collect_set(short).alias("short"), F.max("n").alias("longest")).first()
    lengths, around = sizes.short, max(SPAN, sizes.longest or 0)  # at most SPAN - MIN_WORDS numbers, and one
    bench = materialize(source.mapInArrow(_item_rows(lengths), "item_id long, tokens array<long>, keys array<struct<key:long,pos:int>>"), "items")
    keyed = bench.select("item_id", F.explode("keys").alias("k")).select("item_id", "k.key", F.col("k.pos").alias("item_pos"))
    bloom = spark.sparkContext.broadcast(_bloom.build(keyed.select("key")))
    hits = two_columns(docs, doc_id, text).mapInArrow(_document_rows(lengths, around, bloom), "doc_id long, tokens array<long>, hits array<struct<key:long,pos:int>>")
    hits = materialize(hits.withColumn("sig", F.xxhash64("doc_id", "tokens")), "hits")
    met = hits.select("sig", F.explode("hits").alias("h")).select("sig", "h.key", "h.pos").join(keyed, "key")
    lines = met.select("sig", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    texts = hits.select("sig", "doc_id", "tokens").dropDuplicates(["sig"])
    pairs = lines.join(texts, "sig").join(bench.select("item_id", F.col("tokens").alias("item_tokens")), "item_id")
    found = pairs.select("doc_id", "item_id", "shift", "tokens", "item_tokens").mapInArrow(_verify, "doc_id long, item_id long, matched long, item_words long")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))


def _item_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(Words(part).counts, pa.int32())], ["n"])


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap with an item; all columns as they are."""
    gone = contaminated(docs, items, doc_id, text).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone_id"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
