"""Words of many texts at once: boundaries and 64-bit hashes from byte arrays, without loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kairoflow.llm._batches import text_buffers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of non-ASCII characters make words.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(4096, np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = _BASE
    _POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a slice: ``starts``, ``ends`` (in ``data``), ``counts`` and ``firsts`` per text."""

    def __init__(self, part: pa.RecordBatch, column: int = 1, member: np.ndarray = WORD):
        self.data, self.offsets = text_buffers(part.column(column))
        inside = member[self.data]
        step = np.diff(inside.view(np.int8), prepend=0, append=0)
        first, last = step[:-1] == 1, step[1:] == -1
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(self.starts, self.offsets)
        self.firsts, self.counts = at, np.diff(at)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: np.ndarray = LOWER) -> np.ndarray:
        """A 64-bit hash of each word's folded bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        codes = fold[self.data[place + np.repeat(self.starts, size)]].astype(np.uint64)
        with np.errstate(over="ignore"):
            codes = (codes + np.uint64(1)) * _POWERS[place & 4095]
            return mix(np.add.reduceat(codes, ends - size))
