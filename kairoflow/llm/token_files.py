"""Token ids in flat unsigned-integer files with 64-bit document offsets, memory-mapped on reading.

``write_token_files`` range-partitions documents by id; each task writes three files: ``ids`` (flat
little-endian uint16 where the vocabulary allows, else uint32), ``offsets`` (n+1 int64 positions
within the file) and ``docs`` (int64 doc ids). Names hold a random part, and only files named in the
manifest, which Spark commits with the tasks that succeeded, are ever read: a task that is lost or
run twice leaves files that nobody looks at. Partition bases are prefix sums over the manifest.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairoflow.llm._batches import kept, slices, two_columns
from kairoflow.session import delete_at_end, materialize, new_folder, ship

CACHE = 500_000
END = 2
#: Bytes of text whose new words are encoded in one call.
ENCODE_SLICE = 2 << 20
#: Chunks whose ids are gathered at once.
_GATHER = 1 << 18
#: The word pattern for which ``_plain_words`` holds: letters are one token, marks behind them another.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks without the apostrophe, which opens tokens with letters, and without those of special tokens.
_MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
_MANIFEST = "first_doc long, name string, n_docs long, n_ids long, dtype string"


class WordEncoder:
    """The tokenizers library, as it is by default, behind a cache of whitespace-free chunks.

    Special tokens that stand in a text get their own ids, as the library does; they hold no white
    space. The tokenizer drops white space and never merges across it, so a text's ids are the ids of its
    chunks in order. Chunks are cut at ASCII white space and looked up once a call; two generations of ``CACHE`` are kept. New
    chunks of Latin letters, with or without marks behind them, need no normal form and no word pattern:
    they go to the same model without those steps, all others to the tokenizer as it is.
    """

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        return kept("token_files", path, cls)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if max(self.tokenizer.get_vocab_size() - 1, END) < 1 << 16 else "<u4"
        self.plain = self._plain_words(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _plain_words(self, path: str):
        """The model behind lower-casing alone, if the file's steps are those that this is right for; else None."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        full = self.tokenizer
        steps = [json.loads(x.__getstate__()) if x else {} for x in (full.normalizer, full.pre_tokenizer)]
        normal, split = steps[0].get("normalizers", []), steps[1].get("pretokenizers", [])
        kinds = [x["type"] for x in normal + split]
        special = "".join(x.content for x in full.get_added_tokens_decoder().values())
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or normal[1]["pattern"] != {"Regex": r"\s+"} or split[0]["pattern"] != {"Regex": _SPLIT}:
            return None
        if getattr(full.model, "end_of_word_suffix", None) != "</w>" or full.model.dropout or split[1]["add_prefix_space"] or set(special) & set(_MARKS):
            return None
        plain = Tokenizer.from_file(path)
        plain.normalizer, plain.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.last = np.zeros(full.get_vocab_size(), bool)
        self.last[[i for token, i in full.get_vocab().items() if token.endswith("</w>")]] = True
        return plain

    def _as_it_is(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space, in one call: they are told apart by their numbers afterwards."""
        if not words:
            return []
        got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        cut = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1)).tolist()
        return [ids[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]

    def _as_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters: each is one word to the model, so its last id is one that ends a word."""
        if not words:
            return []
        ids = np.array(self.plain.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(self.last[ids]) + 1
        if len(cut) != len(words) or cut[-1] != len(ids):
            return self._as_it_is(words)
        data, cut = ids.tobytes(), [0, *(cut * ids.itemsize).tolist()]
        return [data[x:y] for x, y in zip(cut[:-1], cut[1:])]

    def learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Bring chunks that aren't in the young cache into it."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        again = missing & self.old.keys()
        self.young.update((c, self.old[c]) for c in again)
        chunks, stems, tails, rest = [], [], [], []
        for c in missing - again:
            word = c.decode()
            stem = word.rstrip(_MARKS)
            if self.plain and stem.isalpha() and (stem.isascii() or max(stem) <= "ÿ"):
                chunks.append(c)
                stems.append(stem)
                tails.append(word[len(stem) :])
            else:
                rest.append(c)
        marks = list(set(tails) - {""})
        known = dict(zip(marks, self._as_it_is(marks))) | {"": b""}
        self.young.update((c, x + known[tail]) for c, x, tail in zip(chunks, self._as_words(stems), tails))
        self.young.update(zip(rest, self._as_it_is([c.decode() for c in rest])))
        return self.young

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Each text's ids as bytes of ``dtype``, without the end id."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        parts = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, chunks))
        holes = [i for i, x in enumerate(found) if x is None]
        known = self.learn({chunks[i] for i in holes})
        for i in holes:
            found[i] = known[chunks[i]]
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        starts, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ends, ids = np.zeros(len(codes) + 1, np.int64), []
        np.cumsum(sizes[codes], out=ends[1:])
        for at in range(0, len(codes), _GATHER):
            code = codes[at : at + _GATHER]
            shift = starts[code] - ends[at : at + len(code)]
            ids.append(flat[np.repeat(shift, sizes[code]) + np.arange(ends[at], ends[at + len(code)])].tobytes())
        data, edges = b"".join(ids), (ends[parts.offsets.to_numpy()] * flat.itemsize).tolist()
        return [data[x:y] for x, y in zip(edges[:-1], edges[1:])]


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END) -> DataFrame:
    """Write the files below ``folder`` and return the manifest, one row per file set, in order:
    first_doc, name, n_docs, n_ids, dtype, base (ids before it), doc_base (documents before it).

    Null and empty texts are a lone end id. Rows that repeat a doc_id follow one another; rows with
    a null doc_id come first, under doc id -2^63. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    where = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, files, place, name = WordEncoder.of(where), None, "", ""
        end, size, at, offsets, ids = np.array([end_id], encoder.dtype).tobytes(), np.dtype(encoder.dtype).itemsize, 0, [0], []
        for part in slices(batches, most=ENCODE_SLICE, operator="token_files"):
            if files is None:
                store, place = _open(folder)
                store.create_dir(place, recursive=True)
                name = uuid.uuid4().hex
                files = store.open_output_stream(f"{place}/{name}.ids")
            got = encoder.encode(part.column(1))
            for x in got:
                files.write(x)
                files.write(end)
                at += len(x) // size + 1
                offsets.append(at)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
        if files is not None:
            files.close()
            every = np.concatenate(ids).astype("<i8")
            for kind, data in (("offsets", np.array(offsets, "<i8")), ("docs", every)):
                with store.open_output_stream(f"{place}/{name}.{kind}") as out:
                    out.write(data.tobytes())
            yield pa.RecordBatch.from_pydict({"first_doc": pa.array([int(every[0])], pa.int64()), "name": [name], "n_docs": pa.array([len(every)], pa.int64()), "n_ids": pa.array([at], pa.int64()), "dtype": [encoder.dtype]})

    ordered = two_columns(docs, doc_id, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = materialize(ordered.mapInArrow(run, _MANIFEST), "manifest")
    # One row per written file set: as many as partitions, not as documents.
    before = Window.orderBy("first_doc").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), zero)).withColumn("doc_base", F.coalesce(F.sum("n_docs").over(before), zero))


class TokenFiles:
    """Random access to one written file set by memory maps (read whole where the store has none)."""

    def __init__(self, folder: str, name: str, dtype: str = "<u2"):
        store, place = _open(folder)

        def view(kind: str, of: str) -> np.ndarray:
            where = f"{place}/{name}.{kind}"
            if isinstance(store, pyarrow.fs.LocalFileSystem):
                return np.memmap(where, of, "r") if os.path.getsize(where) else np.zeros(0, of)
            with store.open_input_file(where) as file:
                return np.frombuffer(file.read(), of)

        self.ids, self.offsets, self.docs = view("ids", dtype), view("offsets", "<i8"), view("docs", "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens (with the end id), ids_crc32."""
    spark = manifest.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files = TokenFiles(folder, row["name"], row["dtype"])
                for at in range(0, len(files), 4096):
                    upto = min(at + 4096, len(files))
                    sums = [zlib.crc32(files[i].astype("<u4").tobytes()) for i in range(at, upto)]
                    starts = files.offsets[at : upto + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(files.docs[at:upto]), pa.array(starts[:-1] + row["base"]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("name", "base", "dtype")
    # As many tasks as file sets: without a number, adaptive execution would put these few short rows into one.
    return files.repartition(max(1, manifest.count()), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    delete_at_end(spark, folder)
    return read_token_files(manifest, folder)
