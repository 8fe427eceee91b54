"""Conversion between events, intervals and states."""

from __future__ import annotations

import warnings
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoflow.functions import parse_duration, shift
from kairoflow.functions.columns import literal
from kairoflow.operators.alignment import anchored
from kairoflow.operators.pool import ID, RANK, TIMES, Pool, by_id


def _recast(pool: Pool, kind: str, entity, names: tuple[str, ...]) -> Pool:
    columns = [ID, RANK, *TIMES[kind], *[c for c in entity.columns if c not in {ID, RANK, "_t", "_start", "_end"}]]
    return replace(pool, kind=kind, entity=entity.select(*columns), time_names=names)


def _period_names(pool: Pool) -> tuple[str, str]:
    return ("start", "end") if pool.kind == "event" else pool.time_names


def _same(pool: Pool) -> Pool:
    warnings.warn(f"the pool holds {pool.kind} sequences already", stacklevel=3)
    return pool


def as_interval(pool: Pool, duration=None) -> Pool:
    """Events with a duration (microseconds or text for calendar times, a number otherwise, or the
    name of a column of such); states as they are."""
    if pool.kind == "interval":
        return _same(pool)
    if pool.kind == "state":
        return replace(pool, kind="interval")
    if duration is None:
        raise ValueError("events need a duration")
    if isinstance(duration, str) and duration in pool.features:
        by = F.col(duration)
        if isinstance(pool.entity.schema[duration].dataType, (T.StringType, T.BooleanType)):
            raise TypeError(f"{duration} isn't a duration")
    elif isinstance(duration, Column):
        by = duration
    else:
        if pool.is_datetime and not isinstance(duration, (str, timedelta)):
            raise TypeError("calendar times need a duration such as '1d'")
        if not pool.is_datetime and not isinstance(duration, (int, float)):
            raise TypeError("numeric times need a number")
        by = F.lit(parse_duration(duration))
    entity = pool.entity.withColumn("_start", F.col("_t")).withColumn("_end", shift(F.col("_t"), by, pool.time_type))
    return _recast(pool, "interval", entity, _period_names(pool))


def as_state(pool: Pool, end_value=None) -> Pool:
    """Events last until the next one; the last ends at ``end_value``: a value, a static column or null."""
    if pool.kind == "state":
        return _same(pool)
    if pool.kind == "interval":
        raise NotImplementedError("intervals may overlap and leave gaps; they can't become states")
    entity = pool.entity.withColumn("_start", F.col("_t")).withColumn("_end", F.lead("_t").over(by_id()))
    if isinstance(end_value, str) and end_value in pool.static_features:
        last = pool.static.select(ID, F.col(end_value).cast(pool.time_type).alias("_last"))
        entity = entity.join(last, ID, "left").withColumn("_end", F.coalesce("_end", "_last")).drop("_last")
    elif end_value is not None:
        entity = entity.withColumn("_end", F.coalesce(F.col("_end"), literal(end_value).cast(pool.time_type)))
    return _recast(pool, "state", entity, _period_names(pool))


def as_event(pool: Pool, anchor: str = "start") -> Pool:
    """Periods at their start, end or middle."""
    if pool.kind == "event":
        return _same(pool)
    return _recast(pool, "event", pool.entity.withColumn("_t", anchored(pool, anchor)), ("time",))
