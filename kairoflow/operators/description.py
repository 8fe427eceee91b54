"""Descriptive statistics, survival targets and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoflow.functions import categories_of, elapsed
from kairoflow.operators.pool import ID, T0, Pool, by_id


def _floor(column, pool: Pool):
    """Statistics of calendar durations are whole microseconds."""
    return F.floor(column).cast("long") if pool.is_datetime else column


def describe(pool: Pool, by_id_: bool = True) -> DataFrame:
    """One row for each id: length, n_unique_entities (nulls count as values), temporal_span, and by
    kind: median_gap, gap_std (events); mean_, median_duration, duration_std (periods); n_transitions,
    n_changes (states). Durations are microseconds for calendar times. n_transitions is one less
    than n_changes and at least 0. Ids without rows have nulls and length 0. ``by_id_=False``: the
    summary of these numbers over ids.
    """
    kind, times = pool.time_type, pool.times
    frame, values = pool.entity, []
    entity = F.struct(*pool.features)
    stats = [F.count("*").alias("length"), F.count_distinct(entity).alias("n_unique_entities"), elapsed(F.min(times[0]), F.max(times[-1]), kind).alias("temporal_span")]
    if pool.kind == "event":
        frame = frame.withColumn("_gap", elapsed(F.lag("_t").over(by_id()), F.col("_t"), kind))
        values = [_floor(F.median("_gap"), pool).alias("median_gap"), _floor(F.stddev_samp("_gap"), pool).alias("gap_std")]
    else:
        frame = frame.withColumn("_d", elapsed(F.col("_start"), F.col("_end"), kind))
        values = [_floor(F.avg("_d"), pool).alias("mean_duration"), _floor(F.median("_d"), pool).alias("median_duration"), _floor(F.stddev_samp("_d"), pool).alias("duration_std")]
    if pool.kind == "state":
        # A comparison with null is not a change, as for the first row.
        changed = F.lit(False)
        for name in pool.features:
            changed = changed | F.coalesce(F.col(name) != F.lag(name).over(by_id()), F.lit(False))
        frame = frame.withColumn("_changed", changed)
        n = F.sum(F.col("_changed").cast("long"))
        values += [F.greatest(n - 1, F.lit(0).cast("long")).alias("n_transitions"), n.alias("n_changes")]
    found = frame.groupBy(ID).agg(*stats, *values)
    if pool.static is not None:
        found = pool.ids().join(found, ID, "left").fillna(0, ["length"])
    found = found.withColumnRenamed(ID, pool.id_name)
    if by_id_:
        return found
    names = [c for c in found.columns if c != pool.id_name]
    functions = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "25%": lambda c: F.percentile(c, F.lit(0.25)),
        "50%": lambda c: F.percentile(c, F.lit(0.5)), "75%": lambda c: F.percentile(c, F.lit(0.75)), "max": F.max,
    }
    row = found.agg(*[f(F.col(c)).cast("double").alias(f"{c}:{k}") for c in names for k, f in functions.items()])
    lines = F.array(*[F.struct(F.lit(k).alias("statistic"), *[F.col(f"`{c}:{k}`").alias(c) for c in names]) for k in functions])
    return row.select(F.explode(lines).alias("s")).select("s.*")


def add_description(pool: Pool, separator: str = "_", prefix: str = "") -> Pool:
    """The pool with each id's description as static features; features of those names are replaced."""
    found = describe(pool)
    named = found.select(pool.id_name, *[F.col(c).alias(f"{prefix}{separator if prefix else ''}{c}") for c in found.columns if c != pool.id_name])
    return pool.add_static_features(named, overwrite=True)


def survival_target(pool: Pool, endpoint_time: str, occurred: str | None = None, censure_time: str | None = None) -> DataFrame:
    """id, occurred, time: from the reference date to the endpoint, or to the censoring date.

    occurred: a static column (null: false), or whether there is an endpoint. Without a censoring
    column the last time of the sequence is taken. Ids whose time is null or not positive, and ids
    that occurred without an endpoint, are left out. Calendar durations are microseconds.
    """
    from kairoflow.operators.alignment import set_t0

    names = [n for n in (endpoint_time, occurred, censure_time) if n]
    pool.checked(names, static=True)
    t0 = (pool if pool.t0 is not None else set_t0(pool)).t0
    frame = pool.static.select(ID, *dict.fromkeys(names)).join(t0, ID, "left")
    if censure_time is None:
        frame = frame.join(pool.entity.groupBy(ID).agg(F.max(pool.times[-1]).alias("_censor")), ID, "left")
    end, kind = F.col(endpoint_time), pool.time_type
    happened = end.isNotNull() if occurred is None else F.coalesce(F.col(occurred).cast("boolean"), F.lit(False))
    until = F.when(happened, end).otherwise(F.col(censure_time or "_censor"))
    frame = frame.select(F.col(ID).alias(pool.id_name), happened.alias("occurred"), elapsed(F.col(T0), until, kind).alias("time"), end.isNotNull().alias("_has"))
    return frame.where((F.col("time") > 0) & ~(F.col("occurred") & ~F.col("_has"))).drop("_has")


def feature_statistics(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Exact statistics by type class, in one aggregation over all rows."""
    wanted: list[tuple[str, str, object]] = []
    for name in names:
        kind, column = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.BooleanType):
            wanted += [(name, "n_true", F.sum(column.cast("long"))), (name, "n_false", F.sum((~column).cast("long")))]
        elif isinstance(kind, T.StringType) and categories_of(df, name) is None:
            wanted += [(name, "min_length", F.min(F.length(column))), (name, "max_length", F.max(F.length(column)))]
        elif isinstance(kind, T.StringType):
            wanted += [(name, "n_unique", F.count_distinct(column))]
        elif isinstance(kind, T.ArrayType):
            wanted += [(name, "dimension", F.max(F.size(column)))]
        elif isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)) and not isinstance(kind, T.DecimalType):
            wanted += [(name, "min", F.min(column)), (name, "max", F.max(column))]
        else:
            raise TypeError(f"{name}: {kind.simpleString()} isn't a feature type")
    row = df.agg(*[e.alias(f"s{i}") for i, (_, _, e) in enumerate(wanted)]).first() if wanted else []
    out: dict[str, dict] = {}
    for (name, key, _), value in zip(wanted, row):
        out.setdefault(name, {"type": df.schema[name].dataType.simpleString(), "categories": categories_of(df, name)})[key] = value
    return out


def metadata(pool: Pool) -> dict:
    """Types and exact statistics of time columns and features."""
    return {
        "kind": pool.kind, "id": pool.entity.schema[ID].dataType.simpleString(),
        "time": feature_statistics(pool.entity, list(pool.times)), "features": feature_statistics(pool.entity, pool.features),
        "static": {} if pool.static is None else feature_statistics(pool.static, pool.static_features),
    }


def compatible(one: Pool, other: Pool) -> list[str]:
    """Why two pools can't be merged: id type, time type, kind, shared features of another type."""
    why = [] if one.kind == other.kind else [f"kinds {one.kind} and {other.kind}"]
    for column in (ID, *one.times):
        if column in other.entity.columns and one.entity.schema[column].dataType != other.entity.schema[column].dataType:
            why.append(f"{column}: {one.entity.schema[column].dataType.simpleString()} and {other.entity.schema[column].dataType.simpleString()}")
    for name in set(one.features) & set(other.features):
        if one.entity.schema[name].dataType != other.entity.schema[name].dataType:
            why.append(f"{name}: types differ")
    return why


__all__ = ["add_description", "describe", "survival_target", "metadata", "feature_statistics", "compatible"]
