"""The pools that the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.operators import Pool, Trajectories, build_events, build_intervals, build_states, build_trajectories


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_mktsegment", "c_acctbal", "c_nationkey")


def events(spark, sf) -> Pool:
    return build_events(table(spark, sf, "events"), "user_id", "ts", features=["event_type", "value"], ordinal="event_id")


def events_static(spark, sf) -> Pool:
    """Events with the static table of all customers: most ids have no row."""
    return build_events(table(spark, sf, "events"), "user_id", "ts", features=["event_type", "value"], ordinal="event_id", static=customers(spark, sf), static_id="id")


def states(spark, sf) -> Pool:
    return build_states(table(spark, sf, "events"), "user_id", "ts", features=["event_type"], ordinal="event_id")


def orders(spark, sf) -> Pool:
    return build_events(table(spark, sf, "orders"), "o_custkey", "o_orderdate", features=["o_orderstatus", "o_totalprice"], ordinal="o_orderkey")


def shipments(spark, sf) -> Pool:
    """Intervals from an order's date to its last shipment."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    frame = table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).where("shipped >= o_orderdate")
    return build_intervals(frame, "o_custkey", "o_orderdate", "shipped", features=["o_orderpriority"], ordinal="o_orderkey")


def trajectories(spark, sf) -> Trajectories:
    return build_trajectories({"events": events(spark, sf), "orders": orders(spark, sf)}, customers(spark, sf), "id")
