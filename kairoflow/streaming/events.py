"""Streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, time: str, late: str = "1 hour", files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files with a watermark on ``time`` (zone-less times count as UTC)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def event_counts(stream: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Rows per tumbling window and keys; late rows up to the watermark are counted."""
    return stream.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def sessions(stream: DataFrame, id: str, time: str, gap: str) -> DataFrame:
    """Sequences cut where an id pauses for ``gap``: id, start, end, length."""
    return stream.groupBy(id, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("length")).select(id, "s.start", "s.end", "length")


def append_to_store(stream: DataFrame, path: str, checkpoint: str):
    """Start writing a stream to Parquet below ``path``, exactly once, by the sink's own log."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
