"""Sources: in-memory frames, CSV, Parquet, SQL (a query on this session, or JDBC)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
_READERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Register a reader ``f(spark, *args, **options)`` under a name."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _READERS[name] = function
        return function

    return add


def source(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """Read by a reader's name."""
    if name not in _READERS:
        raise KeyError(f"no source {name!r}; known: {sorted(_READERS)}")
    return _READERS[name](spark, *args, **options)


@register("frame")
def read_frame(spark: SparkSession, data) -> DataFrame:
    """A Spark DataFrame as it is; pandas, Arrow or row lists become one."""
    return data if isinstance(data, DataFrame) else spark.createDataFrame(data)


@register("csv")
def read_csv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """CSV with a header; naive times become timestamps without zone. Give a schema to avoid the inference pass."""
    reader = spark.read.options(header=True, preferDate=True, **options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    before = spark.conf.get("spark.sql.timestampType")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    try:
        return reader.option("inferSchema", True).csv(path)
    finally:
        spark.conf.set("spark.sql.timestampType", before)


@register("parquet")
def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet files, folders or globs."""
    return spark.read.options(**options).parquet(path)


@register("sql")
def read_sql(spark: SparkSession, query: str, url: str | None = None, parse_dates: tuple[str, ...] = (), **options) -> DataFrame:
    """A query: on this session's tables, or by JDBC where ``url`` is given. ``parse_dates`` names
    string columns that are tried against five date formats; what fits none is null."""
    found = spark.sql(query) if url is None else spark.read.format("jdbc").options(url=url, query=query, **options).load()
    for name in parse_dates:
        found = found.withColumn(name, F.coalesce(*[F.try_to_timestamp(F.col(name), F.lit(f)).cast("timestamp_ntz") for f in _FORMATS]))
    return found
