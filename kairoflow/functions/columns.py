"""Column helpers shared by all operators."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"us": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "min": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}


def as_column(expression: Column | str) -> Column:
    """A Column as it is; text is parsed as a SQL expression."""
    return expression if isinstance(expression, Column) else F.expr(expression)


def is_time(kind: T.DataType) -> bool:
    """Whether a type is a calendar time rather than a number."""
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def parse_duration(value: str | timedelta | int | float) -> int | float:
    """Microseconds of "1d", "12h30m" or a timedelta; numbers are returned as they are."""
    if isinstance(value, timedelta):
        return value // timedelta(microseconds=1)
    if not isinstance(value, str):
        return value
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", value.strip().lower())
    if not parts or any(unit not in _UNITS for _, unit in parts):
        raise ValueError(f"not a duration: {value!r}")
    return int(sum(float(number) * _UNITS[unit] for number, unit in parts))


def elapsed(start: Column, end: Column, kind: T.DataType) -> Column:
    """``end - start``: whole microseconds for calendar times, a number otherwise; null if either is."""
    if not is_time(kind):
        return end - start
    stamp = "timestamp_ntz" if not isinstance(kind, T.TimestampType) else "timestamp"
    return F.timestamp_diff("MICROSECOND", start.cast(stamp), end.cast(stamp))


def shift(time: Column, by: Column, kind: T.DataType) -> Column:
    """A time moved by microseconds (calendar) or by a number; the type stays."""
    if not is_time(kind):
        return (time + by).cast(kind)
    stamp = "timestamp_ntz" if not isinstance(kind, T.TimestampType) else "timestamp"
    return F.timestamp_add("MICROSECOND", by.cast("long"), time.cast(stamp)).cast(kind)


def literal(value) -> Column:
    """A literal whose naive datetimes are timestamps without a zone."""
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, (date, datetime)):
        return F.lit(value)
    return value if isinstance(value, Column) else F.lit(value)


def with_categories(df: DataFrame, column: str, categories: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Mark a string column as categorical in its field metadata; categories are found if not given."""
    if categories is None:
        categories = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    return df.withMetadata(column, {"categorical": True, "categories": list(categories), "ordered": ordered})


def categories_of(df: DataFrame, column: str) -> list[str] | None:
    """The categories a column is marked with, or None."""
    meta = df.schema[column].metadata or {}
    return list(meta["categories"]) if meta.get("categorical") else None
