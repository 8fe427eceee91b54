"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from kairoflow.plans import QUERIES

HEADLINE = (
    "describe_events", "describe_states", "filter_rank_slice", "filter_rank_relative", "pattern_gap", "pattern_witness", "t0_query_floor",
    "binned_events", "binned_intervals", "presence_map", "trajectory_describe", "survival", "occupancy_percent", "dist_edit", "dist_chi2", "dist_dtw",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    QUERIES["describe_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
