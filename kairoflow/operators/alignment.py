"""Reference dates (T0): by position, value, static feature or query; nearest rows; relative time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairoflow.functions import as_column, elapsed, parse_duration, shift
from kairoflow.functions.columns import literal
from kairoflow.operators.pool import ID, NEAREST, RANK, T0, Pool, by_id


def anchored(pool: Pool, anchor: str | None = None) -> Column:
    """A row's time at its start, end or middle; events have one time."""
    if anchor not in (None, "start", "end", "middle"):
        raise ValueError("anchor must be start, end or middle")
    start = F.col(pool.times[0])
    if pool.kind == "event" or anchor in (None, "start"):
        return start
    end = F.col(pool.times[1])
    if anchor == "end":
        return end
    kind = pool.time_type
    half = F.floor(elapsed(start, end, kind) / 2) if pool.is_datetime or kind.typeName() in ("long", "integer", "short", "byte") else (end - start) / 2
    return shift(start, half, kind)


def set_t0(pool: Pool, position: int | None = None, direct=None, feature: str | None = None, query: Column | str | None = None, use_first: bool = True, anchor: str | None = None) -> Pool:
    """A pool with one reference date for each id; ids without one get null.

    ``position``: the row at that place, negative from the end. ``direct``: one value, or a dict by
    id. ``feature``: a static feature. ``query``: the first or last row, by place, that satisfies an
    expression. Without arguments: position 0.
    """
    given = [x is not None for x in (position, direct, feature, query)]
    if sum(given) > 1:
        raise ValueError("give one of position, direct, feature, query")
    time = anchored(pool, anchor)
    if direct is not None:
        if isinstance(direct, dict):
            spark = pool.entity.sparkSession
            known = spark.createDataFrame(list(direct.items()), f"{ID} {pool.entity.schema[ID].dataType.simpleString()}, {T0} {pool.time_type.simpleString()}")
            found = known
        else:
            return replace(pool, t0=pool.ids().withColumn(T0, literal(direct).cast(pool.time_type)))
    elif feature is not None:
        pool.checked([feature], static=True)
        if pool.static.schema[feature].dataType != pool.time_type:
            raise TypeError(f"{feature} has another type than the time columns")
        found = pool.static.select(ID, F.col(feature).alias(T0))
    elif query is not None:
        pick = F.min_by if use_first else F.max_by
        found = pool.entity.where(as_column(query)).groupBy(ID).agg(pick(time, F.col(RANK)).alias(T0))
    else:
        place = position or 0
        counted = pool.entity.withColumn("_place", F.row_number().over(by_id()).cast("long") - 1)
        if place >= 0:
            found = counted.where(F.col("_place") == place).select(ID, time.alias(T0))
        else:
            counted = counted.withColumn("_n", F.count("*").over(Window.partitionBy(ID)))
            found = counted.where(F.col("_place") == F.col("_n") + place).select(ID, time.alias(T0))
    return replace(pool, t0=pool.ids().join(found, ID, "left"))


def nearest(pool: Pool) -> DataFrame:
    """(_id, _t0, _t0_rank): the place of the last row that starts at or before the date.

    No such row: 0; a null date: null. A backward as-of lookup as an equi join and an aggregate.
    """
    t0 = (pool if pool.t0 is not None else set_t0(pool)).t0
    rows = pool.dense().select(ID, RANK, F.col(pool.times[0]).alias("_s"))
    found = rows.join(t0, ID).where(F.col("_s") <= F.col(T0)).groupBy(ID).agg(F.max(RANK).alias("_r"))
    out = t0.join(found, ID, "left")
    return out.select(ID, T0, F.when(F.col(T0).isNotNull(), F.coalesce("_r", F.lit(0).cast("long"))).alias(NEAREST))


def t0_data(pool: Pool) -> DataFrame:
    """id, t0, t0_rank for every id."""
    return nearest(pool).select(F.col(ID).alias(pool.id_name), F.col(T0).alias("t0"), F.col(NEAREST).alias("t0_rank"))


def relative_time(pool: Pool, unit: str = "d") -> DataFrame:
    """The entity table with times as numbers of units since the reference date; ids without one go.

    Numeric times are differences in their own unit."""
    t0 = (pool if pool.t0 is not None else set_t0(pool)).t0.where(F.col(T0).isNotNull())
    joined = pool.entity.join(t0, ID)
    kind = pool.time_type
    scale = parse_duration(f"1{unit}") if pool.is_datetime else 1
    moved = [(elapsed(F.col(T0), F.col(c), kind) / scale).alias(n) for c, n in zip(pool.times, pool.time_names)]
    return joined.select(F.col(ID).alias(pool.id_name), RANK, *moved, *pool.features)
