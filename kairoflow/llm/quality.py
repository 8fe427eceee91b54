"""Quality classifier: Naive Bayes features under a linear support vector machine.

Indicators of hashed n-grams are scaled by the classes' log-count ratios; a linear hinge-loss
model over the scaled, length-normalised indicators is fitted by dual coordinate descent. N-grams
are taken from two streams: the words themselves (1 and 2), and the words' shapes (1 to 3): case,
trailing sign, length and whether a word repeats one of the two before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.llm._batches import slices, two_columns
from kairoflow.llm._words import LOWER, SPACE, Words, mix
from kairoflow.session import ship

#: Hashed features; the weights broadcast are 4 bytes each, whatever the corpus.
FEATURES = 1 << 18
#: Labelled rows the model is fitted on at most: those with the least hash of their doc_id.
MAX_TRAIN = 4000
C, EPOCHS, ALPHA, BETA = 1.0, 12, 1.0, 0.25
_SHAPES = 1 << 18

_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 4 digit, 8 beyond ASCII, 16 sign
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[c for c in range(128) if not (chr(c).isalnum() or c in (9, 10, 11, 12, 13, 32))]] = 16


def _shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A small number for each word's look."""
    starts, ends = words.starts, words.ends
    kinds = _KIND[words.data]
    seen = np.bitwise_or.reduceat(kinds, np.stack([starts, np.minimum(ends, len(kinds) - 1)], 1).ravel())[::2] if len(starts) else np.zeros(0, np.int64)
    if len(starts) and ends[-1] == len(kinds):
        seen[-1] = np.bitwise_or.reduce(kinds[starts[-1] :])
    first_upper = kinds[starts] == 1
    rest_upper = (kinds[np.minimum(starts + 1, ends - 1)] == 1) & first_upper
    tail = words.data[ends - 1].astype(np.int64)
    tail = np.where(kinds[ends - 1] == 16, tail, 0)
    double = (tail > 0) & (ends - starts > 1) & (words.data[np.maximum(ends - 2, 0)] == words.data[ends - 1])
    length = np.minimum(np.log2(ends - starts).astype(np.int64), 6)
    owner = words.owner
    same = np.zeros(len(starts), np.int64)
    for back in (2, 1):
        equal = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        same[back:] = np.where(equal, back, same[back:])
    code = seen  # below 32
    for value, size in ((first_upper, 2), (rest_upper, 2), (tail, 128), (double, 2), (length, 7), (same, 3)):
        code = code * size + value
    return code


def indicators(part: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram that occurs, each once; ordered by text."""
    words = Words(part, column, member=~SPACE)
    hashes = words.hashes(LOWER)
    owner = words.owner
    shapes = mix(_shapes(words, hashes).astype(np.uint64) + np.uint64(1 << 40))
    grams = []
    with np.errstate(over="ignore"):
        for stream, widths, salt in ((hashes, (1, 2), 11), (shapes, (1, 2, 3), 101)):
            key = np.zeros(len(stream), np.uint64)
            for width in range(1, max(widths) + 1):
                n = len(stream) - width + 1
                if n <= 0:
                    break
                key = (key[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ stream[width - 1 :]
                inside = owner[:n] == owner[width - 1 :]
                grams.append((owner[:n][inside].astype(np.int64) * FEATURES) | (mix(key + np.uint64(salt * width)) & np.uint64(FEATURES - 1)).astype(np.int64)[inside])
                key = mix(key)
    flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    flat.sort()
    flat = flat[np.diff(flat, prepend=-1) != 0]
    return flat // FEATURES, flat % FEATURES


@dataclass
class Model:
    """weights already hold the log-count ratios; a constant score where nothing could be learnt."""

    weights: np.ndarray
    bias: float
    slope: float = 2.0

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        text, feature = indicators(part)
        n = part.num_rows
        count = np.bincount(text, minlength=n)
        total = np.bincount(text, self.weights[feature], minlength=n)
        margin = total / np.sqrt(np.maximum(count, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Fit on texts and 0/1 labels; no or one class: a constant score of 0.5 or that class."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES, np.float32), 0.0 if not len(labels) else (2.0 if labels[0] else -2.0))
    rows, at = [], 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    for part in slices(iter([batch])):
        text, feature = indicators(part)
        cut = np.searchsorted(text, np.arange(part.num_rows + 1))
        rows += [feature[a:b] for a, b in zip(cut[:-1], cut[1:])]
    sign = np.where(labels == 1, 1.0, -1.0)
    counts = [np.full(FEATURES, ALPHA), np.full(FEATURES, ALPHA)]
    for row, label in zip(rows, labels):
        counts[int(label == 1)][row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio /= max(1e-9, np.abs(ratio).max())
    # Dual coordinate descent for the L1-loss SVM; the bias is one more constant feature.
    norm = [1 / np.sqrt(max(1, len(row))) for row in rows]
    value = [ratio[row] * scale for row, scale in zip(rows, norm)]
    square = np.array([float(v @ v) + 1 for v in value])
    share = np.where(sign > 0, len(sign) / (2 * (sign > 0).sum()), len(sign) / (2 * (sign < 0).sum()))
    w, b, dual, order = np.zeros(FEATURES), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            slope = sign[i] * (float(w[rows[i]] @ value[i]) + b) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), C * 10 * share[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[rows[i]] += step * value[i]
                b += step
                dual[i] = new
    del at
    mean = np.abs(w).mean()
    w = (1 - BETA) * mean * np.sign(w) * (w != 0) + BETA * w if BETA < 1 and mean > 0 else w
    model = Model((w * ratio).astype(np.float32), b)
    # Interpolation moves the margins; the threshold and the slope are set on the training margins again.
    margin = np.array([float(model.weights[row].sum()) * scale for row, scale in zip(rows, norm)])
    best = _threshold(margin, labels)
    spread = max(1e-6, float(np.std(margin)))
    return Model(model.weights, -best, 4.0 / spread)


def _threshold(margin: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(margin)
    m, y = margin[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    gaps = np.where(wrong == wrong.min(), np.diff(edges), -1)
    at = int(np.argmax(gaps))
    return float((edges[at] + edges[at + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, most: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` labelled rows that aren't held out, on the driver."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = two_columns(docs, doc_id, text).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most ``most`` rows
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], np.array([r.label for r in rows], np.int64)


def held_out(doc_id):
    """True where crc32 of the id as text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> Model:
    return fit(*training_rows(docs, labels, "quality", held_out, most, doc_id, text))


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted. Null and empty texts get the score of no
    n-gram at all; repeated rows are scored each; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part))], ["doc_id", "score"])

    scored = two_columns(docs, doc_id, text).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is under 0.5; all columns as they are, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), texts], ["doc_id", "text"])
            scores = [shared.value.scores(part) for part in slices(iter([plain]))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
