"""Seeded synthetic sequences, made in parallel from row numbers and hashes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairoflow.operators.build import build_events, build_intervals, build_states
from kairoflow.operators.pool import Pool
from kairoflow.operators.trajectory import Trajectories, build_trajectories

_ORIGIN = datetime(2000, 1, 1)
_DAY = 86400 * 10**6


def _uniform(seed: int, tag: str, *keys: str) -> Column:
    """A number in [0, 1) from key columns, a tag and a seed; the same on any cluster."""
    return F.pmod(F.xxhash64(*keys, F.lit(tag), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _rows(spark: SparkSession, n_ids: int, length: tuple[int, int], features: int, categories: tuple[str, ...], seed: int) -> DataFrame:
    low, high = length
    ids = spark.range(n_ids).withColumn("_n", (F.lit(low) + F.floor(_uniform(seed, "n", "id") * (high - low + 1))).cast("int"))
    rows = ids.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    columns = {}
    for i in range(features):
        u = _uniform(seed, f"f{i}", "id", "_k")
        columns[f"feature_{i}"] = F.element_at(F.array(*[F.lit(c) for c in categories]), (F.floor(u * len(categories)) + 1).cast("int")) if i % 2 == 0 else F.round(u * 100, 3)
    return rows.withColumns(columns)


def _times(rows: DataFrame, seed: int, gap: str = "gap") -> DataFrame:
    """A running time: gaps of one second to a day."""
    steps = (F.lit(10**6) + F.floor(_uniform(seed, gap, "id", "_k") * (_DAY - 10**6))).cast("long")
    at = F.sum(steps).over(Window.partitionBy("id").orderBy("_k"))
    return rows.withColumn("time", F.timestamp_add("MICROSECOND", at, F.lit(_ORIGIN.isoformat(sep=" ")).cast("timestamp_ntz")))


def simulate_static(spark: SparkSession, n_ids: int = 100, seed: int = 0) -> DataFrame:
    """id, age, group."""
    group = F.element_at(F.array(*[F.lit(g) for g in "ABCD"]), (F.floor(_uniform(seed, "g", "id") * 4) + 1).cast("int"))
    return spark.range(n_ids).select("id", (18 + F.floor(_uniform(seed, "a", "id") * 73)).cast("int").alias("age"), group.alias("group"))


def simulate_events(spark: SparkSession, n_ids: int = 100, length: tuple[int, int] = (3, 10), features: int = 2, categories: tuple[str, ...] = ("A", "B", "C"), seed: int = 0) -> Pool:
    rows = _times(_rows(spark, n_ids, length, features, categories, seed), seed)
    return build_events(rows, "id", "time", ordinal="_k")


def simulate_intervals(spark: SparkSession, n_ids: int = 100, length: tuple[int, int] = (3, 10), features: int = 2, categories: tuple[str, ...] = ("A", "B", "C"), overlap: bool = True, seed: int = 0) -> Pool:
    """Intervals of up to two days; without ``overlap`` each ends before the next starts."""
    rows = _times(_rows(spark, n_ids, length, features, categories, seed), seed)
    ends = F.timestamp_add("MICROSECOND", (1 + F.floor(_uniform(seed, "d", "id", "_k") * 2 * _DAY)).cast("long"), F.col("time"))
    if not overlap:
        ends = F.least(ends, F.coalesce(F.lead("time").over(Window.partitionBy("id").orderBy("_k")), ends))
    return build_intervals(rows.withColumn("end", ends), "id", "time", "end", ordinal="_k")


def simulate_states(spark: SparkSession, n_ids: int = 100, length: tuple[int, int] = (3, 10), features: int = 1, categories: tuple[str, ...] = ("A", "B", "C"), seed: int = 0) -> Pool:
    rows = _times(_rows(spark, n_ids, length, features, categories, seed), seed)
    return build_states(rows, "id", "time", ordinal="_k")


def simulate_trajectories(spark: SparkSession, n_ids: int = 100, seed: int = 0) -> Trajectories:
    """Events, intervals and states of the same ids, with a static table."""
    pools = {"events": simulate_events(spark, n_ids, seed=seed), "intervals": simulate_intervals(spark, n_ids, seed=seed + 1), "states": simulate_states(spark, n_ids, seed=seed + 2)}
    return build_trajectories(pools, simulate_static(spark, n_ids, seed))
