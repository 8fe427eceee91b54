"""Repeated byte strings by a Burrows-Wheeler transform, stopped at the minimum length.

Every ``LENGTH``-byte string of the corpus is given an anchor by its own content: the place of the
least hash of ``GRAM`` bytes in it. Equal strings have equal anchors at equal places, so only
strings of one anchor hash need to be compared, and each belongs to exactly one anchor's region (the
run of strings that share the anchor). Anchors that occur once are done with; regions that are
equal byte for byte are one region with a count. The distinct regions of each remaining anchor meet
in one task, which sorts their suffixes, takes the transform, and derives common prefixes by
breadth-first backward extension: a round extends the current intervals by one symbol to the left
and fixes the boundaries whose common prefix is that long. After ``LENGTH`` rounds the boundaries
left open lie between suffixes that share ``LENGTH`` bytes or more.

Anchors with more distinct region bytes than ``GROUP_BYTES`` would be too much for one task; their
strings are compared by 128-bit hashes in a distributed aggregation, which counts before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.llm import _bloom
from kairoflow.llm._batches import slices, text_buffers, two_columns
from kairoflow.llm._words import mix
from kairoflow.session import materialize, ship

LENGTH, GRAM = 400, 100
#: Region bytes whose suffixes are sorted together; an anchor with more goes the other way.
BATCH_BYTES = GROUP_BYTES = 1 << 20
#: Strings per piece of a text; positions in a piece have 24 bits.
_PIECE = 1 << 22
_BLOCK = 1 << 17
_BITS = 21
_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _tables:
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _tables[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _tables[size]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position (as many as there are)."""
    n = len(data) - gram + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down = _powers(_BLOCK + gram)
    with np.errstate(over="ignore"):
        for at in range(0, n, _BLOCK):
            block = data[at : at + _BLOCK + gram - 1]
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
            m = len(block) - gram + 1
            out[at : at + m] = mix((sums[gram:] - sums[:m]) * down[:m])
    return out


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima within blocks from both sides."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Regions of a slice's texts: (text, start in the text, bytes, span, copies, hash, two region hashes).

    Neighbouring regions that are equal byte for byte (long periods) are one row with their number
    as ``copies``; span is what they cover together.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    hashes = gram_hashes(data, gram)
    key = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding_min(key, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(least))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[text + 1]
    start, text, least = start[inside], text[inside], least[inside]
    if not len(start):
        return none
    new = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(start)) - 1
    begin, size = start[new], start[last] + length - start[new]
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[a : a + n]) for a, n in zip(begin.tolist(), size.tolist())]), np.uint64).reshape(-1, 2)
    owner, value = text[new], hashes[least[new]]
    again = np.zeros(len(new), bool)
    again[1:] = (value[1:] == value[:-1]) & (both[1:] == both[:-1]).all(1) & (owner[1:] == owner[:-1])
    head = np.flatnonzero(~again)
    tail = np.append(head[1:], len(new)) - 1
    return owner[head], begin[head] - offsets[owner[head]], size[head], begin[tail] + size[tail] - begin[head], tail - head + 1, value[head], both[head, 0], both[head, 1]


def sort_suffixes(regions: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, suffix array, its inverse): each region is followed by a terminator of its own.

    Symbols are bytes plus one, terminators zero; they rank by region. Ranks of 4 symbols are
    doubled until every suffix is told apart or seen to its terminator.
    """
    size = np.array([len(r) + 1 for r in regions])
    total = int(size.sum())
    if total >= 1 << _BITS:
        raise ValueError("too many bytes for one sort")
    sym = np.zeros(total + 4, np.int64)
    flat = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    ends = np.cumsum(size) - 1
    sym[:total] = flat.astype(np.int64) + 1
    sym[ends] = 0
    left = np.repeat(ends, size) - np.arange(total)
    pos = np.arange(total)
    key = np.zeros(total, np.int64)
    for j in range(4):
        key = (key << 9) | np.where(left >= j, sym[j : j + total], 0)
    mask, step, longest = (1 << _BITS) - 1, 4, int(size.max())
    order = np.sort((key << _BITS) | pos)
    rank = np.empty(total, np.int64)
    while True:
        sa, value = order & mask, order >> _BITS
        fresh = np.diff(value, prepend=-1) != 0
        if step >= longest or fresh.all():
            break
        rank[sa] = np.cumsum(fresh)
        second = np.zeros(total, np.int64)
        far = left >= step
        second[far] = rank[pos[far] + step]
        order = np.sort((rank << 2 * _BITS) | (second << _BITS) | pos)
        step *= 2
    inverse = np.empty(total, np.int64)
    inverse[sa] = pos
    return sym[:total], sa, inverse


def shared_prefixes(sym: np.ndarray, sa: np.ndarray, inverse: np.ndarray, least: int) -> np.ndarray:
    """True for each suffix (by position) that shares ``least`` symbols or more with another one."""
    n = len(sa)
    before = sa - 1
    bwt, lf = sym[before].astype(np.int16), inverse[before]
    by_symbol = np.argsort(bwt, kind="stable")
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    counts = np.bincount(sym, minlength=2)
    edges = np.concatenate([[0], np.cumsum(counts)])
    ends = int(counts[0])
    fixed = np.zeros(n + 1, bool)
    fixed[: ends + 1] = fixed[n] = True
    symbols = np.flatnonzero(counts[1:]) + 1
    low = np.concatenate([np.arange(ends), edges[symbols]])
    high = np.concatenate([np.arange(ends) + 1, edges[symbols + 1]])
    fixed[high] = True
    for _ in range(1, least):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        which = np.repeat(np.arange(len(low)), size)
        flat = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
        symbol = bwt[flat]
        live = symbol > 0
        first = live & (preceding[flat] < low[which])
        last = live & (following[flat] >= high[which])
        pack = (which << 9) | symbol
        # The first and the last of a symbol in an interval are paired by sorting both the same way.
        one = np.sort((pack[first] << _BITS) | flat[first]) & ((1 << _BITS) - 1)
        two = np.sort((pack[last] << _BITS) | flat[last]) & ((1 << _BITS) - 1)
        low, high = lf[one], lf[two] + 1
        new = ~fixed[high]
        low, high = low[new], high[new]
        fixed[high] = True
    open_ = np.flatnonzero(~fixed)
    found = np.zeros(n, bool)
    found[sa[open_]] = found[sa[open_ - 1]] = True
    return found


def repeated_in(regions: list[bytes], least: int = LENGTH) -> list[np.ndarray]:
    """For each region, whether the string of ``least`` bytes at each start also starts elsewhere in them."""
    found = shared_prefixes(*sort_suffixes(regions), least)
    out, at = [], 0
    for region in regions:
        out.append(found[at : at + max(0, len(region) - least + 1)])
        at += len(region) + 1
    return out


def _runs(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Covered byte ranges of the flagged starts."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [{"a": int(x[0]), "b": int(x[-1]) + length} for x in np.split(at, cut)]


_RANGES = "array<struct<a:int,b:int>>"
_RANGE_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "sig", "start", "size", "span", "copies", "anchor", "r1", "r2"]
        for part in slices(batches):
            ids, sigs = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy()
            data, offsets = text_buffers(part.column(1))
            # A text longer than a piece is cut into pieces that share length - 1 bytes: each string is in one.
            step = _PIECE if len(data) > _PIECE + length else len(data) + 1
            for at in range(0, max(1, len(data) - length + 1), step):
                upto = min(len(data), at + step + length - 1)
                text, start, size, span, copies, value, r1, r2 = anchors(data[at:upto], np.clip(offsets - at, 0, upto - at), length, gram)
                start = start + np.maximum(at - offsets[text], 0)
                columns = (ids[text], sigs[text], start, size.astype(np.int32), span, copies, value.view(np.int64), r1.view(np.int64), r2.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted regions of joined texts."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("anchor", "r1", "r2", "body")}
        for i in range(batch.num_rows):
            body = batch.column(0)[i].as_py().encode()
            for w in batch.column(1)[i].as_py():
                for k in ("anchor", "r1", "r2"):
                    out[k].append(w[k])
                out["body"].append(body[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("anchor", "r1", "r2")), pa.array(out["body"], pa.binary())], list(out))


def _compare(length: int):
    """Groups come in order of their anchor; whole groups are compared in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_in([r[3] for r in rows], length)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([_runs(f, length) for f in flags], _RANGE_TYPE)], ["anchor", "r1", "r2", "ranges"]
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > BATCH_BYTES // 2 and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
                if size > BATCH_BYTES + BATCH_BYTES // 2:  # the last group is small, by its bound: carry it over
                    cut = next(i for i, r in enumerate(held) if r[0] == row[0])
                    if cut:
                        yield flush(held[:cut])
                        held = held[cut:]
                        size = sum(len(r[3]) + 1 for r in held)
        if held:
            yield flush(held)

    return run


def _string_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for anchor, r1, r2, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(body) - length + 1
                both = np.frombuffer(b"".join([digest(body[i : i + length]) for i in range(n)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(n, x, np.int64)) for x in (anchor, r1, r2)), pa.array(np.arange(n, dtype=np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    ["anchor", "r1", "r2", "at", "w1", "w2"],
                )

    return run


def _hot_ranges(regions: DataFrame, length: int) -> DataFrame:
    """Ranges of regions of crowded anchors, by counting hashes of their strings."""
    hashed = regions.mapInArrow(_string_hashes(length), "anchor long, r1 long, r2 long, at int, w1 long, w2 long")
    twice = hashed.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    starts = hashed.join(twice, ["w1", "w2"], "left_semi").groupBy("anchor", "r1", "r2").agg(F.array_sort(F.collect_list("at")).alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = []
            for ats in batch.column(3).to_pylist():
                flags = np.zeros(ats[-1] + 1, bool)
                flags[ats] = True
                ranges.append(_runs(flags, length))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ranges, _RANGE_TYPE)], ["anchor", "r1", "r2", "ranges"])

    return starts.mapInArrow(run, f"anchor long, r1 long, r2 long, ranges {_RANGES}")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, sig): sig tells rows apart that repeat a doc_id with another text."""
    plain = two_columns(docs, doc_id, text)
    return plain.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("sig"))


def _maybe(keyed: DataFrame, bloom) -> DataFrame:
    """Rows whose sig may be in a Bloom filter, before their texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bloom.may_hold(bloom.value, batch.column(2).to_numpy().view(np.uint64))
            if len(at):
                yield batch.take(pa.array(at))

    return keyed.mapInArrow(run, keyed.schema)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, sig, ranges): the bytes covered by ``length``-byte strings that also start elsewhere.

    Only rows with such bytes are listed; ranges may touch or overlap.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs, doc_id, text)
    rows = materialize(
        keyed.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length, gram), "doc_id long, sig long, start long, size int, span long, copies long, anchor long, r1 long, r2 long"),
        "anchors",
    )
    groups = rows.groupBy("anchor").agg(F.sum("copies").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("r1", "r2") for k, f in (("lo", F.min), ("hi", F.max))))
    groups = groups.where("n > 1").select("anchor", ((F.col("lo_r1") != F.col("hi_r1")) | (F.col("lo_r2") != F.col("hi_r2"))).alias("mixed"))
    met = materialize(rows.join(groups, "anchor"), "met")
    # Distinct regions of the anchors that have several, each with one place it can be read from.
    where = F.struct("doc_id", "sig", "start", "size")
    distinct = materialize(met.where("mixed").groupBy("anchor", "r1", "r2").agg(F.sum("copies").alias("copies"), F.min(where).alias("place")), "regions")
    wanted = distinct.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.sig").alias("sig")).agg(
        F.collect_list(F.struct("anchor", "r1", "r2", F.col("place.start").alias("start"), F.col("place.size").alias("size"))).alias("wanted")
    )
    bloom = spark.sparkContext.broadcast(_bloom.build(distinct.select(F.col("place.sig").alias("key"))))
    bodies = _maybe(keyed, bloom).dropDuplicates(["doc_id", "sig"]).join(wanted, ["doc_id", "sig"]).select("text", "wanted")
    bodies = bodies.mapInArrow(_cut_regions, "anchor long, r1 long, r2 long, body binary")
    weight = distinct.groupBy("anchor").agg(F.sum("place.size").alias("bytes"))
    crowded = materialize(weight.where(F.col("bytes") > GROUP_BYTES // 2).select("anchor"), "crowded")
    if crowded.isEmpty():
        ranges = bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), f"anchor long, r1 long, r2 long, ranges {_RANGES}")
    else:
        bodies = materialize(bodies, "bodies")
        calm = bodies.join(crowded, "anchor", "left_anti")
        ranges = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), f"anchor long, r1 long, r2 long, ranges {_RANGES}")
        ranges = ranges.unionByName(_hot_ranges(bodies.join(crowded, "anchor", "left_semi"), length))
    single = ranges.where(F.size("ranges") > 0)
    several = distinct.where("copies > 1").select("anchor", "r1", "r2", F.lit(True).alias("whole"))
    known = single.join(several, ["anchor", "r1", "r2"], "full")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("span").cast("int").alias("b")))
    mixed = met.where("mixed").join(known, ["anchor", "r1", "r2"]).select("doc_id", "sig", "start", F.when(F.col("whole"), whole).otherwise(F.col("ranges")).alias("ranges"))
    uniform = met.where("not mixed").select("doc_id", "sig", "start", whole.alias("ranges"))
    moved = F.transform("ranges", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b")))
    spans = mixed.unionByName(uniform).select("doc_id", "sig", moved.alias("ranges"))
    return spans.groupBy("doc_id", "sig").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _cut(body: bytes, ranges: list[dict]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    kept, at, removed, runs = [], 0, 0, 0
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if a > at or not runs:
            kept.append(body[at:a])
            removed, runs, at = removed + b - a, runs + 1, b
        elif b > at:
            removed, at = removed + b - at, b
    return b"".join([*kept, body[at:]]), removed, runs


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, bodies: bool = True) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) unless ``bodies`` is false.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same text included; all strings are judged on the input. Null and empty texts have no bytes and
    lose none; texts shorter than ``length`` lose none; rows that repeat a text lose all of it if it
    is long enough. A null doc_id stays null. Texts of any length are cut into overlapping pieces
    for the search. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    spans = materialize(repeated_spans(docs, doc_id, text, length, gram), "spans")
    bloom = spark.sparkContext.broadcast(_bloom.build(spans.select(F.col("sig").alias("key"))))
    keyed = _keyed(docs, doc_id, text)
    extra, schema = (", kept binary", ["kept"]) if bodies else ("", [])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *schema]
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * len(names)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def one(doc: int, body: bytes, ranges: list) -> tuple:
        kept, removed, runs = _cut(body, ranges)
        out = (doc if doc != -(1 << 63) else None, len(body), removed, runs, hashlib.sha256(kept).hexdigest())
        return (*out, kept) if bodies else out

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            maybe = set(_bloom.may_hold(bloom.value, part.column(2).to_numpy().view(np.uint64)).tolist())
            found = [(i, d) for i, d in enumerate(part.column(0).to_pylist()) if i not in maybe]
            yield rows([one(d, part.column(1)[i].as_py().encode(), []) for i, d in found])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield rows([one(d, t.encode(), r or []) for d, t, r in zip(*(part.column(i).to_pylist() for i in range(3)))])

    rest = _maybe(keyed, bloom).join(spans, ["doc_id", "sig"], "left").select("doc_id", "text", "ranges")
    return keyed.mapInArrow(untouched, kinds).unionByName(rest.mapInArrow(touched, kinds))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), bodies=False)
