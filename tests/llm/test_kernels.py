"""Kernels of the corpus operators against brute force, the tokenizers' own libraries and round trips."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from kairoflow.llm import _bloom, bpe, near_dups, quality, simhash, suffix_array, token_files, toxicity
from kairoflow.llm._batches import slices
from kairoflow.llm._words import SPACE, Words

TEXTS = [
    "", "  ", "a", " a b", "x  y\n\n z\t  q", "Ünï CÖDE\x00 x", "日本語 のテキスト", "a" * 3000, "\n", "\n\n", " \n ", "foo\nbar", "foo \nbar", "foo\n", "foo bar\n",
    "Title\tpage\n\nBody", " a\tb", "a\u00a0b c", "a\r\nb", "a\x0bb\n\nc", "\ta", "a \n", "a\n b",
    "it's we'll 123 abc123!!", "😀😀 👍🏽", "é x", "\x1c\x1d a\x85b", "The quick brown fox\njumps over the lazy dog. " * 40,
]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_the_library_and_round_trips(tokenizer):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("ab \nÄ.'1s") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    # White space of every kind beside words, where a mistaken cut would go unnoticed.
    texts += ["".join(rng.choice(["a", "b.", "it's", "é1", " ", " ", "\n", "\n", "\t", "\r\n", "\u00a0", "\x0b", "\x1c", "\u2028", "\u3000"]) for _ in range(rng.randint(0, 14))) for _ in range(10_000)]
    for _ in range(2):  # the second time from the caches
        got = tokenizer.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
        assert [tokenizer.decode(g) for g in got] == [t.encode() for t in texts]
    lists = [np.frombuffer(g, "<u4").tolist() for g in got[:40]]
    assert bpe.decode_ordered(public_tokenizers.path("byte_bpe_50k.tiktoken"), lists) == [t.encode() for t in texts[:40]]


def test_bpe_caches_turn_over(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    texts = [f"word{i} other{i % 7} word{i}" for i in range(50)]
    once = tokenizer.encode(texts)
    assert [tokenizer.encode([t])[0] for t in texts] == once and [tokenizer.decode(g).decode() for g in once] == texts


def test_word_tokenizer_equals_the_library():
    encoder = token_files.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = TEXTS + [f"a {x} b{x}c {x.upper()} {x[:-1]}" for x in special]
    texts += ["".join(rng.choice(["a", "B.", "it's", "é1", " ", "\n", "\t", "\u00a0", "\x1c", "\u2028", *special]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    plain = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, encoder.dtype).tolist() for g in encoder.encode([t.encode() for t in texts])] == plain


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_fingerprints():
    assert simhash.fingerprints(batch(TEXTS)).tolist() == [slow_simhash(t) for t in TEXTS]


def test_words_stay_in_their_texts():
    words = Words(batch(["ab cd", "", "cd", "  ", "ef"]), member=~SPACE)
    assert words.counts.tolist() == [2, 0, 1, 0, 1] and words.hashes()[1] == words.hashes()[2]


def test_bloom_has_no_false_negative(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    bloom = _bloom.build(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"))
    assert len(_bloom.may_hold(bloom, keys)) == len(keys)
    assert len(_bloom.may_hold(bloom, rng.integers(0, 1 << 63, 5000).astype(np.uint64))) < 50


@pytest.mark.parametrize("seed", range(8))
def test_backward_extension_against_counting(seed):
    rng = random.Random(seed)
    least, letters = rng.choice([4, 8, 12]), rng.choice([b"ab", b"abc\x00\xff", bytes(range(256))])
    regions = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
    for _ in range(6):
        part = rng.choice(regions)
        at = rng.randint(0, len(part))
        regions.append(part[at : at + rng.randint(1, 30)] + bytes(rng.choice(letters) for _ in range(5)))
    counts = Counter(r[i : i + least] for r in regions for i in range(len(r) - least + 1))
    assert [f.tolist() for f in suffix_array.repeated_in(regions, least)] == [[counts[r[i : i + least]] > 1 for i in range(len(r) - least + 1)] for r in regions]


def test_anchor_regions_cover_each_string_once():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choice(b"abcd ") for _ in range(4000)) + b"z" * 900, np.uint8)
    offsets = np.array([0, 1000, 1000, 1700, len(data)])
    seen = Counter()
    for text, start, size, span, copies, *_ in zip(*suffix_array.anchors(data, offsets, 50, 10)):
        n = (span - size) + (size - 50 + 1)
        seen.update((int(text), int(start) + i) for i in range(n))
        assert copies >= 1
    assert set(seen) == {(t, i) for t in range(4) for i in range(offsets[t + 1] - offsets[t] - 49)} and max(seen.values()) == 1


def test_cut_merges_touching_ranges():
    assert suffix_array._cut(b"abcdefghij", [{"a": 2, "b": 4}, {"a": 4, "b": 5}, {"a": 3, "b": 4}, {"a": 8, "b": 9}]) == (b"abfghj", 4, 2)
    assert suffix_array._cut(b"abc", []) == (b"abc", 0, 0)


def test_shingles_and_set_digests():
    texts = ["a b c d e f", "A b  c d e F", "a b", "", "x " * 30]
    sets = near_dups.shingles(batch(texts))
    assert sets[0].tolist() == sets[1].tolist() and [len(s) for s in sets] == [2, 2, 1, 1, 1]
    names = near_dups.set_digests(sets)
    assert (names[0] == names[1]).all() and len({tuple(x) for x in names.tolist()}) == 4


def labelled(bad, good, n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        plain = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        labels.append(i % 2)
        texts.append(" ".join(good(plain, rng) if i % 2 else bad(plain, rng)))
    return texts, np.array(labels)


def test_quality_held_out_accuracy():
    bad = lambda w, r: [x.upper() + "!!" for x in w] if r.random() < 0.5 else [x + "###" for x in w]
    texts, labels = labelled(bad, lambda w, r: w, 400, 0)
    model = quality.fit(texts[:300], labels[:300])
    scores = np.concatenate([model.scores(p) for p in slices(iter([batch(texts[300:])]))])
    assert ((scores >= 0.5) == labels[300:]).mean() > 0.97 and ((0 <= scores) & (scores <= 1)).all()
    assert quality.fit([], np.array([])).scores(batch(["", "x"])).tolist() == [0.5, 0.5]
    assert (quality.fit(["a"], np.array([1])).scores(batch(["", "x"])) > 0.5).all()


def test_toxicity_gradient_and_held_out_accuracy():
    net = toxicity.Network.fresh(1)
    x = toxicity.prepare(batch(["some words that are read both ways " * 3, "", "others follow them"]))
    y, weight = np.array([1, 0, 1])[x.text].astype(np.float32), np.ones(len(x.text), np.float32)
    g, _ = net.gradient(x, y, weight)

    def loss():
        z = net.logits(x).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for key in ("Uf", "Ub", "Wf", "bb", "A", "v", "o"):
        at = (0,) * net.p[key].ndim
        old = net.p[key][at]
        net.p[key][at] = old + 1e-2
        up = loss()
        net.p[key][at] = old - 1e-2
        down = loss()
        net.p[key][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[key][at], rel=0.05, abs=2e-6)

    def bad(words, rng):
        for _ in range(6):
            words[rng.randrange(len(words))] = rng.choice(["grumpf", "blarghen", "blarghish", "snarkle"])
        return words

    texts, labels = labelled(lambda w, r: w, bad, 600, 1)
    net = toxicity.fit(texts[:500], labels[:500], epochs=6)
    scores = np.concatenate([net.scores(p) for p in slices(iter([batch(texts[500:])]))])
    assert ((scores >= 0.5) == labels[500:]).mean() > 0.9
    assert net.scores(batch(["", " "])).shape == (2,)


def test_windows_cover_every_word():
    text = " ".join(f"w{i}" for i in range(61))
    x = toxicity.prepare(batch([text, "", "one"]))
    assert sorted(set(x.windows[x.text == 0].ravel()) - {-1}) != [] and len(set(x.windows[x.text == 0].ravel()) - {-1}) == 61
    assert (x.windows[x.text == 1] == -1).all() and [int((x.text == t).sum()) for t in range(3)] == [5, 1, 1]


def test_band_keys_ignore_repetition():
    rng = random.Random(12)
    base = [" ".join("".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(rng.randint(80, 400))) for _ in range(50)]
    one, two = (near_dups.band_keys(near_dups.shingles(batch(texts))) for texts in (base, [f"{t} {t}" for t in base]))
    assert (one == two).any(1).all()
