"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a word embedding (hashed) plus the mean of its hashed character n-gram
embeddings. Overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, cover every text; a GRU
reads each window both ways, attention pools its states, and a logistic layer scores it. A
document's score is a logistic function of its windows' greatest and mean score, also fitted.

Input projections are computed once per distinct word of a slice, and windows of one slice run
through the recurrence together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.llm._batches import slices, two_columns
from kairoflow.llm._words import LOWER, Words, mix
from kairoflow.llm.quality import training_rows
from kairoflow.session import ship

WINDOW, STRIDE = 24, 12
WORDS, GRAMS = 1 << 14, 1 << 14
SIZE, HIDDEN = 8, 8
#: Character n-grams of these lengths, word ends marked.
LENGTHS = (3, 4, 5)
#: Labelled rows the network is trained on at most: those with the least hash of their doc_id. All of their windows are.
MAX_TRAIN = 4000
EPOCHS, RATE, BATCH = 4, 0.01, 256
#: Small training sets are read more often, up to so many steps in all or so many times.
STEPS, MOST_EPOCHS = 100, 8
#: Windows that run through the recurrence at once.
_AT_ONCE = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Inputs:
    """Distinct words of a slice: word bucket, n-gram buckets (flat, with ``cuts``), and each
    window's words as rows of distinct-word numbers (-1: no word), with its text."""

    word: np.ndarray
    grams: np.ndarray
    cuts: np.ndarray
    windows: np.ndarray
    text: np.ndarray
    n: int


def prepare(part: pa.RecordBatch, column: int = 1) -> Inputs:
    """Windows of every text; a text without words has one empty window."""
    words = Words(part, column)
    hashes = words.hashes(LOWER)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    # Bytes of the distinct words, with a mark before and after each.
    size = (words.ends - words.starts)[first]
    ends = np.cumsum(size + 2)
    flat = np.full(int(ends[-1]) if len(ends) else 0, 1, np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[place + np.repeat(ends - size - 1, size)] = LOWER[words.data[place + np.repeat(words.starts[first], size)]]
    owner = np.repeat(np.arange(len(size)), size + 2)
    grams, whose = [], []
    with np.errstate(over="ignore"):
        key = np.zeros(len(flat), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            m = max(0, len(flat) - n + 1)
            key = key[:m] * np.uint64(0x100000001B3) + flat[n - 1 : n - 1 + m] + np.uint64(1)
            if n in LENGTHS:
                inside = owner[:m] == owner[n - 1 : n - 1 + m]
                grams.append((mix(key[inside] + np.uint64(n << 56)) & np.uint64(GRAMS - 1)).astype(np.int32))
                whose.append(owner[:m][inside])
    order = np.argsort(np.concatenate(whose), kind="stable") if whose else []
    grams, whose = np.concatenate(grams)[order], np.concatenate(whose)[order]
    cuts = np.searchsorted(whose, np.arange(len(distinct) + 1))
    # Windows start every STRIDE words until one reaches the text's end.
    count = words.counts
    each = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(part.num_rows), each)
    start = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = at < count[text][:, None]
    index = np.where(inside, at + words.firsts[:-1][text][:, None], 0)
    windows = np.where(inside, number[index] if len(number) else -1, -1).astype(np.int32)
    return Inputs((distinct & np.uint64(WORDS - 1)).astype(np.int32), grams, cuts, windows, text, part.num_rows)


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        p = {"word": draw(WORDS, SIZE, by=0.1), "gram": draw(GRAMS, SIZE, by=0.3)}
        for way in "fb":
            p |= {f"W{way}": draw(2 * SIZE, 3 * HIDDEN), f"U{way}": draw(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": draw(2 * HIDDEN, 2 * HIDDEN), "a": np.zeros(2 * HIDDEN, np.float32), "v": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "ob": np.zeros(1, np.float32), "doc": np.array([1, 0, 0], np.float32)}
        return cls(p)

    def inputs(self, x: Inputs) -> np.ndarray:
        """Each distinct word's input: its embedding beside the mean of its n-grams'."""
        if not len(x.word):
            return np.zeros((0, 2 * SIZE), np.float32)
        size = np.maximum(np.diff(x.cuts), 1)
        # Every word has an n-gram: the marks make one letter a gram of three.
        summed = np.add.reduceat(self.p["gram"][x.grams], x.cuts[:-1], axis=0)
        return np.concatenate([self.p["word"][x.word], summed / size[:, None].astype(np.float32)], 1)

    def read(self, table: np.ndarray, windows: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (time, window, HIDDEN) of one direction; padding leaves a state as it was."""
        n, steps = windows.shape
        U, h = self.p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            index = windows[:, t]
            x = table[index]
            s = h @ U
            zr = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            live = (index >= 0).astype(np.float32)[:, None]
            new = h + live * (1 - z) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, s[:, 2 * HIDDEN :], live))
            out[t] = h = new
        return out

    def tables(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """Input projections of the distinct words; the last row is for padding."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        return {way: np.concatenate([words @ self.p[f"W{way}"] + self.p[f"b{way}"], pad]) for way in "fb"}

    def pool(self, h: np.ndarray, mask: np.ndarray):
        """Attention over time: (context, weights, hidden layer of the attention)."""
        u = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask, u @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        return np.einsum("tn,tnk->nk", w, h), w, u

    def logits(self, x: Inputs) -> np.ndarray:
        tables, out = self.tables(self.inputs(x)), np.empty(len(x.windows), np.float32)
        for at in range(0, len(x.windows), _AT_ONCE):
            part = x.windows[at : at + _AT_ONCE]
            h = np.concatenate([self.read(tables[way], part, way) for way in "fb"], 2)
            context, _, _ = self.pool(h, (part >= 0).T)
            out[at : at + _AT_ONCE] = context @ self.p["o"] + self.p["ob"]
        return out

    def gradient(self, x: Inputs, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient of the weighted logistic loss over a batch of windows, and the logits."""
        p, words = self.p, self.inputs(x)
        tables, mask = self.tables(words), (x.windows >= 0).T
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.read(tables[way], x.windows, way, kept[way]) for way in "fb"], 2)
        context, w, u = self.pool(h, mask)
        logit = context @ p["o"] + p["ob"][0]
        d = ((_sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        g = {"o": context.T @ d, "ob": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["o"]
        dw = np.einsum("nk,tnk->tn", dc, h)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tn,tnk->k", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tnk,tnj->kj", h, du), du.sum((0, 1))
        dh = w[:, :, None] * dc + du @ p["A"].T
        dwords = np.zeros_like(words)
        for way, span in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            back, U = np.zeros((len(target), HIDDEN), np.float32), p[f"U{way}"]
            g[f"U{way}"], dtable = np.zeros_like(U), np.zeros_like(tables[way])
            for t, before, z, r, c, sc, live in reversed(kept[way]):
                total = dh[t][:, span] + back
                dnew = total * live
                dcand = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (before - c) * z * (1 - z)
                dr = dcand * sc * r * (1 - r)
                ds = np.concatenate([dz, dr, dcand * r], 1)
                np.add.at(dtable, x.windows[:, t], np.concatenate([dz, dr, dcand], 1))
                g[f"U{way}"] += before.T @ ds
                back = total * (1 - live) + dnew * z + ds @ U.T
            dtable = dtable[:-1]
            g[f"W{way}"], g[f"b{way}"] = words.T @ dtable, dtable.sum(0)
            dwords += dtable @ p[f"W{way}"].T
        g["word"] = (x.word, dwords[:, :SIZE])
        size = np.diff(x.cuts)
        g["gram"] = (x.grams, np.repeat(dwords[:, SIZE:] / np.maximum(size, 1)[:, None].astype(np.float32), size, axis=0))
        return g, logit

    def documents(self, x: Inputs, logit: np.ndarray | None = None) -> np.ndarray:
        """(greatest, mean) window logit of each text."""
        logit = self.logits(x) if logit is None else logit
        cut = np.searchsorted(x.text, np.arange(x.n))
        size = np.diff(np.append(cut, len(x.text)))
        return np.stack([np.maximum.reduceat(logit, cut), np.add.reduceat(logit, cut) / size], 1) if x.n else np.zeros((0, 2))

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        a, b, c = self.p["doc"]
        d = self.documents(prepare(part))
        return _sigmoid(np.clip(a * d[:, 0] + b * d[:, 1] + c, -30, 30)).astype(np.float64)


class _Adam:
    """Adam; embedding rows without a gradient are left as they are."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.s, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict, rate: float) -> None:
        self.t += 1
        scale = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for key, grad in g.items():
            rows = slice(None)
            if isinstance(grad, tuple):
                rows, where = np.unique(grad[0], return_inverse=True)
                total = np.zeros((len(rows), grad[1].shape[1]), np.float32)
                np.add.at(total, where, grad[1])
                grad = total
            m, s = self.m[key], self.s[key]
            m[rows] = 0.9 * m[rows] + 0.1 * grad
            s[rows] = 0.999 * s[rows] + 0.001 * grad * grad
            p[key][rows] -= scale * m[rows] / (np.sqrt(s[rows]) + 1e-6)


def _some(x: Inputs, rows: np.ndarray) -> Inputs:
    """The inputs of some windows, with only the words they hold."""
    used, number = np.unique(x.windows[rows], return_inverse=True)
    windows = number.reshape(len(rows), -1).astype(np.int32) - int(used[0] < 0)
    used = used[used >= 0]
    size = np.diff(x.cuts)[used]
    at = np.arange(int(size.sum())) + np.repeat(x.cuts[used] - (np.cumsum(size) - size), size)
    return Inputs(x.word[used], x.grams[at], np.concatenate([[0], np.cumsum(size)]), windows, x.text[rows], x.n)


def fit(texts: list[str], labels: np.ndarray, epochs: int | None = None, seed: int = 0) -> Network:
    """Train on texts and 0/1 labels; no or one class: the network scores that class always.

    Windows carry their text's label. After two epochs windows of label-1 texts that the network
    finds harmless are left out, but for the worst one of each text, as most of them hold nothing.
    """
    net, labels = Network.fresh(seed), np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        net.p["doc"] = np.array([0, 0, 0 if not len(labels) else (4 if labels[0] else -4)], np.float32)
        return net
    rng, adam = np.random.default_rng(seed), _Adam(net.p)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts, at = [], 0
    for part in slices(iter([batch])):
        parts.append((prepare(part), labels[at : at + part.num_rows]))
        at += part.num_rows
    rare = max(1.0, min(8.0, float((labels == 0).sum()) / max(1, (labels == 1).sum())))
    if epochs is None:
        steps = sum(-(-len(x.text) // BATCH) for x, _ in parts)
        epochs = max(EPOCHS, min(MOST_EPOCHS, STEPS // steps))
    for epoch in range(epochs):
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for i in rng.permutation(len(parts)):
            x, y = parts[i]
            rows = np.arange(len(x.text))
            if epoch >= 2:
                logit = net.logits(_some(x, rows))
                top = np.full(x.n, -np.inf)
                np.maximum.at(top, x.text[rows], logit)
                rows = rows[(y[x.text[rows]] == 0) | (logit > 0) | (logit == top[x.text[rows]])]
            rng.shuffle(rows)
            for a in range(0, len(rows), BATCH):
                some = _some(x, np.sort(rows[a : a + BATCH]))
                target = y[some.text].astype(np.float32)
                g, _ = net.gradient(some, target, np.where(target == 1, rare, 1).astype(np.float32))
                adam.step(net.p, g, rate)
    d = np.concatenate([net.documents(x) for x, _ in parts])
    net.p["doc"] = _logistic(d, labels)
    return net


def _logistic(d: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for a logistic model of (greatest, mean, 1), lightly held to zero."""
    centre, spread = d.mean(0), d.std(0) + 1e-6
    x = np.concatenate([(d - centre) / spread, np.ones((len(d), 1))], 1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * w)
    return np.array([*(w[:2] / spread), w[2] - (w[:2] * centre / spread).sum()], np.float32)


def held_out(doc_id):
    """True where 5 divides crc32 of the id as text; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> Network:
    return fit(*training_rows(docs, labels, "toxic", held_out, most, doc_id, text))


def score_toxicity(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted. Null and empty texts are one empty window;
    repeated rows are scored each; very long texts only have more windows; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # a fixed number of weights, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part))], ["doc_id", "score"])

    scored = two_columns(docs, doc_id, text).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
