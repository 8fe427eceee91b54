"""Column helpers: durations as microseconds, expressions from text, category metadata."""

from kairoflow.functions.columns import as_column, categories_of, elapsed, is_time, parse_duration, shift, with_categories

__all__ = ["as_column", "categories_of", "elapsed", "is_time", "parse_duration", "shift", "with_categories"]
