"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Text is split by the tokenizer's pattern. In a worker's DuckDB, token-position rows of the distinct
pieces not seen before join the merge table; each round contracts the leftmost pair of minimum rank
of every piece, until no piece has a pair left. An ordered aggregation decodes each piece's ids, and
must give the piece back. Documents then are runs of known pieces.

Costs that are bounded: the cache is two generations of some ``CACHE`` entries each; a piece
longer than ``LONG_PIECE`` bytes, whose rounds would grow with the square of its length, is merged
by a heap with the same order of contractions instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kairoflow.llm._batches import kept, slices, two_columns
from kairoflow.session import ship

CACHE = 400_000
LONG_PIECE = 256
#: Bytes of text whose new pieces are merged together.
BPE_SLICE = 2 << 20
#: Pieces that one recursive query takes; more would leave the CPU's caches.
QUERY_PIECES = 20_000

_MERGE = """
WITH RECURSIVE t(done, w, pos, id, npos, nid, r) AS (
  SELECT false, w, pos, id, npos, nid, m.r FROM base LEFT JOIN merges m ON m.k = id::BIGINT * 65536 + nid
  UNION ALL
  (WITH best AS (SELECT w, min(r::BIGINT * 1048576 + pos) AS b FROM t WHERE NOT done GROUP BY w),
   hit AS (SELECT best.w, b % 1048576 AS p, b // 1048576 AS c, t.npos AS q FROM best JOIN t ON t.w = best.w AND t.pos = b % 1048576 WHERE b IS NOT NULL),
   pair AS (SELECT hit.w, p, q, c, x.npos AS q2, x.nid AS n2 FROM hit JOIN t x ON x.w = hit.w AND x.pos = hit.q),
   moved AS (SELECT pair.c IS NULL AS done, t.w, t.pos,
       CASE WHEN t.pos = pair.p THEN pair.c ELSE t.id END AS id,
       CASE WHEN t.pos = pair.p THEN pair.q2 ELSE t.npos END AS npos,
       CASE WHEN t.pos = pair.p THEN pair.n2 WHEN t.npos = pair.p THEN pair.c ELSE t.nid END AS nid,
       t.r, (t.pos = pair.p OR t.npos = pair.p) AS touched
     FROM t LEFT JOIN pair ON pair.w = t.w WHERE NOT t.done AND (pair.q IS NULL OR t.pos <> pair.q))
   SELECT done, w, pos, id, npos, nid, CASE WHEN touched THEN m.r ELSE moved.r END
   FROM moved LEFT JOIN merges m ON m.k = CASE WHEN touched THEN id::BIGINT * 65536 + nid END))
SELECT w, list(id ORDER BY pos) AS ids, string_agg(h, '' ORDER BY pos) AS hexed FROM t JOIN vocab USING (id) WHERE done GROUP BY w ORDER BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Tokenizer:
    """One vocabulary's DuckDB tables and the cache of chunks and pieces; a worker process keeps it
    while it serves tasks of this operator."""

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        return kept("bpe", path, cls)

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        by_id = {i: b for b, i in self.ranks.items()}
        size = max(by_id) + 1
        self.lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 16 | b, rank))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        keys = np.array(pairs, np.int64).reshape(-1, 2)
        merges = pa.table({"k": keys[:, 0], "r": keys[:, 1].astype(np.int32)})
        vocab = pa.table({"id": pa.array(list(by_id), pa.int32()), "h": [b.hex() for b in by_id.values()]})
        self.db.register("merges_in", merges)
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in; CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of pieces that aren't tokens themselves."""
        found: list[bytes] = [b""] * len(words)
        short = [i for i, word in enumerate(words) if len(word) <= LONG_PIECE]
        for i in range(len(words)):
            if len(words[i]) > LONG_PIECE:
                found[i] = self.merge_long(words[i])
        for at in range(0, len(short), QUERY_PIECES):
            part = short[at : at + QUERY_PIECES]
            size = np.array([len(words[i]) for i in part])
            ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
            ends = np.cumsum(size)
            pos = (np.arange(len(ids)) - np.repeat(ends - size, size)).astype(np.int32)
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            self.db.register("base", pa.table({
                "w": np.repeat(np.arange(len(part), dtype=np.int32), size), "pos": pos, "id": ids,
                "npos": np.where(last, -1, pos + 1).astype(np.int32), "nid": np.where(last, -1, np.append(ids[1:], -1)).astype(np.int32),
            }))
            got = self.db.sql(_MERGE).to_arrow_table().combine_chunks()
            if "".join(got["hexed"].to_pylist()) != b"".join(words[i] for i in part).hex():
                raise ValueError("a piece doesn't survive the round trip")
            lists = got["ids"].chunk(0)
            flat, cut = lists.values.to_numpy().astype("<u4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            for i, x, y in zip(part, cut[:-1], cut[1:]):
                found[i] = flat[x:y]
        return found

    def merge_long(self, word: bytes) -> bytes:
        """The same contractions in the same order, by a heap over linked positions."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        ends, back, ahead = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap, get = [], self.ranks.get

        def push(i: int) -> None:
            j = ahead[i]
            if j < n and (rank := get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (rank, i, ends[i], ends[j]))

        for i in range(n):
            push(i)
        while heap:
            rank, i, end, other = heapq.heappop(heap)
            if ids[i] < 0 or ends[i] != end or ahead[i] >= n or ends[ahead[i]] != other:
                continue
            j = ahead[i]
            ids[i], ids[j], ends[i], ahead[i] = rank, -1, ends[j], ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = i
            push(i)
            if back[i] >= 0:
                push(back[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.young]
        self.young.update((p, self.old[p]) for p in new if p in self.old)
        todo = []
        for piece in new:
            if piece in self.young:
                continue
            word = piece.encode()
            rank = self.ranks.get(word)
            if rank is None:
                todo.append((piece, word))
            else:
                self.young[piece] = rank.to_bytes(4, "little")
        self.young.update(zip([p for p, _ in todo], self.merge([w for _, w in todo])))

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Bring chunks that aren't in the young cache into it; most chunks are one piece."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        again = missing & self.old.keys()
        self.young.update((c, self.old[c]) for c in again)
        cut = {chunk: self.split.findall(chunk) for chunk in missing - again}
        self._learn_pieces({p for pieces in cut.values() for p in pieces})
        known = self.young
        known.update([(chunk, b"".join([known[p] for p in pieces])) for chunk, pieces in cut.items() if len(pieces) != 1])
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Where words are parted by one space or one line end each and by nothing else, no piece
        crosses from one word to the next, and words are looked up as they are; all other texts are
        split by the pattern.
        """
        parts = []
        for text in texts:
            body = text[:-1] if text.endswith("\n") else text
            words, gaps = body.split(), body.count(" ") + body.count("\n")
            # One character in each gap, and none of them anything but a space or a line end.
            if not words or len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(body):
                parts.append(self.split.findall(text))
                continue
            part = body.replace("\n", "\n\n").replace(" ", "\n ").split("\n")
            if "" in part:  # an empty part stands for a line end
                part = [p or "\n" for p in part]
            parts.append(part + ["\n"] if body is not text else part)
        found = [list(map(self.young.get, part)) for part in parts]
        holes = [(part, got, [i for i, x in enumerate(got) if x is None]) for part, got in zip(parts, found) if None in got]
        known = self.learn({part[i] for part, _, at in holes for i in at})
        for part, got, at in holes:
            for i in at:
                got[i] = known[part[i]]
        return [b"".join(got) for got in found]

    def round_trip(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Each text's ids and the bytes decoded from them, which must be the text's own."""
        ids = self.encode(texts)
        decoded = [self.decode(x) for x in ids]
        if any(x != text.encode() for x, text in zip(decoded, texts)):
            raise ValueError("a text doesn't survive the round trip")
        return ids, decoded

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, gathered from the vocabulary in order."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.lengths[tokens]
        shift = self.starts[tokens] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()


def decode_ordered(path: str, ids: list[list[int]]) -> list[bytes]:
    """Decode id lists by one DuckDB join and an aggregation ordered by position."""
    db = Tokenizer.of(path).db
    size = [len(x) for x in ids]
    flat = np.fromiter((t for x in ids for t in x), np.int32, sum(size))
    ends = np.cumsum([0, *size])
    db.register("tokens", pa.table({"d": np.repeat(np.arange(len(ids)), size), "pos": np.arange(len(flat)) - np.repeat(ends[:-1], size), "id": flat}))
    got = dict(db.execute("SELECT d, string_agg(h, '' ORDER BY pos) FROM tokens JOIN vocab USING (id) GROUP BY d").fetchall())
    return [bytes.fromhex(got.get(i, "")) for i in range(len(ids))]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: doc_id, ids (array of int). Null and empty texts have no ids; repeated rows
    are encoded each; no order is promised; an empty table gives no rows. Other columns aren't read."""
    ship(docs.sparkSession)
    where = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.of(where)
        for part in slices(batches, most=BPE_SLICE, operator="bpe"):
            got, _ = tokenizer.round_trip(part.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return two_columns(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row: doc_id, text bytes (binary) by ordered aggregation; null ids count as none."""
    ship(encoded.sparkSession)
    where = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = decode_ordered(where, [x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def token_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again).

    Null and empty texts have no tokens; repeated rows are encoded each; very long texts are one
    slice of their own; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    where = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.of(where)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches, most=BPE_SLICE, operator="bpe"):
            got, back = tokenizer.round_trip(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([digest(x) for x in got]), pa.array([digest(x) for x in back])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return two_columns(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
