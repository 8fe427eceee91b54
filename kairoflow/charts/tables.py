"""Chart tables: category bars, state occupancy, durations, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairoflow.errors import ChartError
from kairoflow.functions import elapsed, parse_duration
from kairoflow.functions.columns import literal
from kairoflow.operators.pool import ID, RANK, Pool
from kairoflow.session import materialize

MAX_CATEGORIES, MAX_FACETS, MAX_IDS = 30, 20, 30


def _labelled(pool: Pool, feature: str, facet: str | None, nulls: str) -> DataFrame:
    """Entity rows with label and facet; null labels are dropped, named "N/A", or refused."""
    pool.checked([feature])
    frame = pool.entity.withColumn("label", F.col(feature).cast("string"))
    if facet is not None:
        if facet in pool.static_features:
            frame = frame.join(pool.static.select(ID, F.col(facet).cast("string").alias("facet")), ID, "left")
        else:
            pool.checked([facet])
            frame = frame.withColumn("facet", F.col(facet).cast("string"))
    else:
        frame = frame.withColumn("facet", F.lit("all"))
    if nulls == "drop":
        return frame.where(F.col("label").isNotNull() & F.col("facet").isNotNull())
    if nulls == "label":
        return frame.fillna("N/A", ["label", "facet"])
    if not frame.where(F.col("label").isNull() | F.col("facet").isNull()).isEmpty():
        raise ChartError("null labels")
    return frame


def _guard(frame: DataFrame, column: str, most: int) -> None:
    if frame.select(column).distinct().limit(most + 1).count() > most:
        raise ChartError(f"over {most} values of {column}")


def bar_table(pool: Pool, feature: str, show_as: str = "count", facet: str | None = None, nulls: str = "drop", sort: str = "alphabetic", guard: bool = False) -> DataFrame:
    """facet, label, value: number of rows, share within the facet, or summed duration (microseconds).

    Whole durations are summed as decimals. Sums are long where all fit, else decimal(38,0): the
    type depends on the sums, so that durations run the aggregation at once.
    """
    frame = _labelled(pool, feature, facet, nulls)
    if guard:
        _guard(frame, "label", MAX_CATEGORIES)
        _guard(frame, "facet", MAX_FACETS)
    if show_as == "duration":
        if pool.kind == "event":
            raise ChartError("events have no duration")
        spent = elapsed(F.col("_start"), F.col("_end"), pool.time_type)
        if whole := frame.select(spent.alias("x")).schema["x"].dataType.typeName() == "long":
            spent = spent.cast("decimal(19,0)")
        value = F.coalesce(F.sum(spent), F.lit(0))
    elif show_as in ("count", "rate"):
        value = F.count("*")
    else:
        raise ValueError("show_as must be count, rate or duration")
    out = frame.groupBy("facet", "label").agg(value.alias("value"))
    if show_as == "duration" and whole:
        out = materialize(out.withColumn("value", F.col("value").cast("decimal(38,0)")), "durations")
        if out.where(F.col("value").try_cast("long").isNull()).isEmpty():
            out = out.withColumn("value", F.col("value").cast("long"))
    if show_as == "rate":
        out = out.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("facet")))
    order = {"alphabetic": [F.col("label")], "ascending": [F.col("value"), F.col("label")], "descending": [F.col("value").desc(), F.col("label")]}[sort]
    return out.orderBy("facet", *order)


def occupancy_table(pool: Pool, feature: str, bin_size, mode: str = "percentage", facet: str | None = None, nulls: str = "drop") -> DataFrame:
    """facet, bin, label, value: states open at each bin's first instant (start <= bin < end).

    A state meets the bins of its own span only: they are computed from its start and end, so there
    is no join with the axis. A null end is open until the last time of the pool.
    """
    if pool.kind != "state":
        raise ChartError("occupancy needs states")
    kind, size = pool.time_type, parse_duration(bin_size)
    low, high = pool.entity.agg(F.min("_start"), F.max(F.greatest("_start", F.coalesce("_end", "_start")))).first()
    if low is None:
        raise ChartError("the pool is empty")
    base = literal(low).cast(kind)
    start, end = elapsed(base, F.col("_start"), kind), elapsed(base, F.coalesce(F.col("_end"), literal(high).cast(kind)), kind)
    first, last = F.ceil(start / F.lit(size)).cast("long"), (F.ceil(end / F.lit(size)) - 1).cast("long")
    frame = _labelled(pool, feature, facet, nulls).where(last >= first).withColumn("bin", F.explode(F.sequence(first, last)))
    out = frame.groupBy("facet", "bin", "label").agg(F.count_distinct(ID).alias("value"))
    if mode not in ("count", "proportion", "percentage"):
        raise ValueError("mode must be count, proportion or percentage")
    if mode != "count":
        share = F.col("value") / F.sum("value").over(Window.partitionBy("facet", "bin"))
        out = out.withColumn("value", share * (100 if mode == "percentage" else 1))
    return out


def span_table(pool: Pool, feature: str, unit: str = "d", facet: str | None = None, nulls: str = "drop") -> DataFrame:
    """facet, label, duration (in ``unit``) of each period, and its label's median as ``median``."""
    if pool.kind == "event":
        raise ChartError("events have no duration")
    scale = parse_duration(f"1{unit}") if pool.is_datetime else 1
    frame = _labelled(pool, feature, facet, nulls)
    frame = frame.select("facet", "label", (elapsed(F.col("_start"), F.col("_end"), pool.time_type) / scale).alias("duration")).where("duration is not null")
    medians = frame.groupBy("facet", "label").agg(F.median("duration").alias("median"))
    return frame.join(medians, ["facet", "label"])


def timeline_table(pool: Pool, feature: str, relative: bool = False, unit: str = "d", facet: str | None = None, nulls: str = "drop", guard: bool = False) -> DataFrame:
    """Rows with a line number ``y`` for each id, in order of ids (within the facet).

    The number is a rank over distinct ids, joined back to the rows.
    """
    frame = _labelled(pool, feature, facet, nulls)
    if guard:
        _guard(frame, ID, MAX_IDS)
    if relative:
        from kairoflow.operators.alignment import relative_time

        moved = relative_time(pool, unit).withColumnRenamed(pool.id_name, ID).select(ID, RANK, *pool.time_names)
        frame = frame.join(moved, [ID, RANK])
        times = list(pool.time_names)
    else:
        times = list(pool.times)
    lines = frame.select("facet", ID).distinct().withColumn("y", F.dense_rank().over(Window.partitionBy("facet").orderBy(ID)).cast("long") - 1)
    return frame.join(lines, ["facet", ID]).select(F.col(ID).alias(pool.id_name), "facet", "label", "y", *[F.col(t).alias(n) for t, n in zip(times, pool.time_names)])


def draw(table: DataFrame, x: str, y: str, kind: str = "bar"):
    """A matplotlib axis of a small table, where matplotlib is installed."""
    import matplotlib.pyplot as plt

    data = table.toPandas()
    axis = plt.figure().gca()
    getattr(axis, {"bar": "bar", "line": "plot", "scatter": "scatter"}[kind])(data[x], data[y])
    return axis
