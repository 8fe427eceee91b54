"""Bloom filters of one fixed size, built by DataFrame aggregation: what is broadcast never grows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^25 bits, 4 MB, whatever the number of keys; with too many keys it only lets more through.
BITS, PROBES = 25, 3


def _places(key):
    mask = (1 << BITS) - 1
    return F.array(*[F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(mask)) for shift in (0, 13, 37)])


def build(keys: DataFrame, key: str = "key") -> np.ndarray:
    """The filter's bytes over a column of well-mixed 64-bit keys; nulls are ignored."""
    places = keys.where(F.col(key).isNotNull()).select(F.explode(_places(F.col(key))).alias("p")).distinct()
    parts = places.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    bloom = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts.collect():  # at most 2^10 rows of 4 kB
        bloom[row.bucket << 12 : (row.bucket + 1) << 12] = np.frombuffer(bytes(row.bits), np.uint8)
    return bloom


def may_hold(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the uint64 keys that may be in the filter."""
    found = np.arange(len(keys))
    for shift in (0, 13, 37):
        place = (keys[found] >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
        hit = (bloom[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        found = found[hit.astype(bool)]
    return found
