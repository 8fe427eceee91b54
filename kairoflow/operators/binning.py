"""Fixed-width bins: long tables of ids by bins, and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoflow.functions import elapsed, parse_duration
from kairoflow.operators.pool import ID, RANK, Pool

#: More bins are refused unless ``max_bins`` is given.
MAX_BINS = 2000

#: Rows that one task makes, about.
ROWS_AT_ONCE = 2_000_000

#: What becomes of several rows in a bin; sums of nothing are 0.
RULES = {
    "first": lambda c: F.min_by(c, F.col(RANK)), "last": lambda c: F.max_by(c, F.col(RANK)), "mean": F.avg, "max": F.max, "min": F.min,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "median": F.median, "std": F.stddev_samp, "var": F.var_samp,
    "n_unique": lambda c: F.count_distinct(c) + F.max(c.isNull().cast("int")), "count": F.count,
}


def resolve(pools: list[Pool], bin_size, max_bins: int | None):
    """(least time, bin size in native units, estimated bins) over all time columns of the pools."""
    first = pools[0]
    if first.is_datetime == (not isinstance(bin_size, str)):
        raise TypeError("calendar times need a bin size such as '1d', numeric times a number")
    size = parse_duration(bin_size)
    if size <= 0:
        raise ValueError("the bin size must be positive")
    low = high = None
    for pool in pools:
        row = pool.entity.agg(
            F.least(*[F.min(c) for c in pool.times], F.lit(None)) if len(pool.times) > 1 else F.min(pool.times[0]),
            F.greatest(*[F.max(c) for c in pool.times], F.lit(None)) if len(pool.times) > 1 else F.max(pool.times[0]),
            *[F.count_if(F.col(c).isNull()) for c in pool.times],
        ).first()
        if any(row[2:]):
            raise ValueError("time columns hold nulls; fill or drop them first")
        if row[0] is not None:
            low, high = row[0] if low is None else min(low, row[0]), row[1] if high is None else max(high, row[1])
    if low is None:
        raise ValueError("the pool is empty")
    span = (high - low) // _microsecond() if first.is_datetime else high - low
    bins = int(span // size) + 1
    if max_bins is None and bins > MAX_BINS:
        raise ValueError(f"about {bins} bins; over {MAX_BINS} need an explicit max_bins")
    return low, size, bins


def _microsecond():
    from datetime import timedelta

    return timedelta(microseconds=1)


def _bin(time: Column, low: Column, size, pool: Pool) -> Column:
    return F.floor(elapsed(low, time, pool.time_type) / F.lit(size)).cast("long")


def _spans(pool: Pool, low, size) -> DataFrame:
    """Entity rows with their first and last bin; rows that end before they start, or before the first bin, are left out."""
    from kairoflow.functions.columns import literal

    base = literal(low).cast(pool.time_type)
    if pool.kind == "event":
        frame = pool.entity.withColumn("_first", _bin(F.col("_t"), base, size, pool))
        return frame.where("_first >= 0").withColumn("_last", F.col("_first"))
    start, end = F.greatest(_bin(F.col("_start"), base, size, pool), F.lit(0).cast("long")), _bin(F.col("_end"), base, size, pool)
    return pool.entity.where(end >= start).withColumns({"_first": start, "_last": end})


def assigned(pool: Pool, low, size) -> DataFrame:
    """Entity rows with ``_bin``: events have one, periods every bin from their start's to their end's."""
    return _in_bins(_spans(pool, low, size), pool)


def _in_bins(spans: DataFrame, pool: Pool) -> DataFrame:
    column = F.col("_first") if pool.kind == "event" else F.explode(F.sequence("_first", "_last"))
    return spans.withColumn("_bin", column).drop("_first", "_last")


def aggregated(pool: Pool, features: list[str], low, size, rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"overlap_rule must be one of {sorted(RULES)}")
    return _by_bin(assigned(pool, low, size), features, rule)


def _by_bin(rows: DataFrame, features: list[str], rule: str) -> DataFrame:
    return rows.groupBy(ID, "_bin").agg(*[RULES[rule](F.col(f)).alias(f) for f in features])


def _gridded(pool: Pool, spans: DataFrame, names: list[str], rule: str, bins: int, cells: int) -> DataFrame:
    """Every id's bins: those that have rows, and the others with nulls.

    Rows are dealt by id into so many tasks that none makes more than some ``ROWS_AT_ONCE`` rows, and
    an id's empty bins are filled in from its own list: the grid itself is never sorted or moved.
    """
    spark = pool.entity.sparkSession
    ids = pool.ids()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(cells + ids.count() * bins) // ROWS_AT_ONCE))
    found = _by_bin(_in_bins(spans.repartition(tasks, ID), pool), names, rule)
    kinds = {n: found.schema[n].dataType for n in names}
    lists = found.groupBy(ID).agg(F.collect_list(F.struct("_bin", *names)).alias("_cells"))
    both = ids.repartition(tasks, ID).join(lists, ID, "left")
    axis = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    empty = lambda free: F.transform(free, lambda b: F.struct(b.alias("_bin"), *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()]))
    full = F.when(F.col("_cells").isNull(), empty(axis)).otherwise(F.concat("_cells", empty(F.array_except(axis, F.transform("_cells", lambda c: c["_bin"])))))
    return both.select(ID, F.inline(full))


def binned_data(pool: Pool, features=None, bin_size=None, max_bins: int | None = None, fill_value=None, overlap_rule: str = "first", ohe: bool = False, bin_col: str = "bin") -> DataFrame:
    """One row for each id and bin: id, bin, features. Ids without rows are kept.

    The first bin starts at the least time of the pool. Rows of a bin are resolved by
    ``overlap_rule``; bins from ``max_bins`` on are cut. ``ohe`` one-hot encodes string features.
    """
    names = pool.checked(features)
    low, size, _ = resolve([pool], bin_size, max_bins)
    if ohe:
        pool, names = _one_hot(pool, names)
    if overlap_rule not in RULES:
        raise ValueError(f"overlap_rule must be one of {sorted(RULES)}")
    spans = _spans(pool, low, size)
    if max_bins is not None:
        spans = spans.where(F.col("_first") < max_bins).withColumn("_last", F.least("_last", F.lit(max_bins - 1).cast("long")))
    top, cells = spans.agg(F.max("_last"), F.sum(F.col("_last") - F.col("_first") + 1)).first()
    bins = max_bins if max_bins is not None else 1 if top is None else int(top) + 1
    out = _gridded(pool, spans, names, overlap_rule, bins, int(cells or 0))
    if fill_value is not None:
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(fill_value)) for n in names})
    return out.select(F.col(ID).alias(pool.id_name), F.col("_bin").alias(bin_col), *names)


def _one_hot(pool: Pool, names: list[str]) -> tuple[Pool, list[str]]:
    from dataclasses import replace

    from kairoflow.functions import categories_of

    columns, out = {}, []
    for name in names:
        if pool.entity.schema[name].dataType.typeName() != "string":
            out.append(name)
            continue
        values = categories_of(pool.entity, name) or [r[0] for r in pool.entity.select(name).where(F.col(name).isNotNull()).distinct().collect()]
        for value in sorted(values):
            columns[f"{name}_{value}"] = (F.coalesce(F.col(name) == value, F.lit(False))).cast("byte")
            out.append(f"{name}_{value}")
    return replace(pool, entity=pool.entity.withColumns(columns)), out


def to_tensor(pool: Pool, features=None, bin_size=None, **options):
    """(array of ids x bins x features, ids, feature names) on the driver."""
    import numpy as np

    frame = binned_data(pool, features, bin_size, **options)
    bin_col = options.get("bin_col", "bin")
    names = [c for c in frame.columns if c not in (pool.id_name, bin_col)]
    rows = frame.orderBy(pool.id_name, bin_col).collect()
    ids = list(dict.fromkeys(r[pool.id_name] for r in rows))
    bins = len(rows) // max(1, len(ids))
    kind = object if any(frame.schema[n].dataType.typeName() == "string" for n in names) else float
    values = np.array([[np.nan if r[n] is None and kind is float else r[n] for n in names] for r in rows], dtype=kind)
    return values.reshape(len(ids), bins, len(names)), ids, names
