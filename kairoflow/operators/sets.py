"""Unions of pools and splits of ids."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from kairoflow.operators.description import compatible
from kairoflow.operators.pool import ID, Pool


def extend(pool: Pool, other: Pool, on_duplicate: str = "raise") -> Pool:
    """Both pools' sequences. Ids in both: an error, or those of ``other`` are left out ("skip")."""
    why = compatible(pool, other)
    if why:
        raise ValueError(f"the pools can't be merged: {'; '.join(why)}")
    if on_duplicate not in ("raise", "skip"):
        raise ValueError("on_duplicate must be raise or skip")
    mine = pool.ids()
    if on_duplicate == "raise":
        both = other.ids().join(mine, ID, "left_semi").limit(6).collect()
        if both:
            raise ValueError(f"ids in both pools: {[r[0] for r in both[:5]]}")
        new = lambda df: df
    else:
        new = lambda df: df.join(mine, ID, "left_anti")
    statics = [s for s in (pool.static, None if other.static is None else new(other.static)) if s is not None]
    static = statics[0] if len(statics) == 1 else statics[0].unionByName(statics[1], allowMissingColumns=True) if statics else None
    return replace(pool, entity=pool.entity.unionByName(new(other.entity), allowMissingColumns=True), static=static, t0=None)


def split(pool: Pool, ratio: float | None = None, count: int | None = None, seed: int | None = None) -> tuple[Pool, Pool]:
    """Two pools over disjoint ids: a share or a number of ids in the first.

    Ids are put in order of a seeded hash; only the cut, one value, comes to the driver.
    """
    if (ratio is None) == (count is None):
        raise ValueError("give ratio or count")
    if ratio is not None and not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    keyed = pool.ids().withColumn("_key", F.xxhash64(F.col(ID), F.lit(seed if seed is not None else random.randrange(1 << 30))))
    total = keyed.count()
    n = count if count is not None else int(total * ratio)
    if not 0 < n < total:
        raise ValueError(f"{n} of {total} ids")
    first = keyed.orderBy("_key", ID).limit(n).select(ID)
    return pool.subset(first), pool.subset(pool.ids().join(first, ID, "left_anti"))
