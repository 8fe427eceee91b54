"""Arrow record batches in and out of Python workers, in slices of bounded bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices end before this many bytes of text, or after one document.
SLICE_BYTES = 1 << 20
_kept: dict[tuple[str, str], object] = {}
_last = ""


def kept(operator: str, key: str, make: Callable[[str], object]):
    """``make(key)``, kept by this worker process until another operator's task comes to it."""
    release(operator)
    if (operator, key) not in _kept:
        _kept[operator, key] = make(key)
    return _kept[operator, key]


def release(operator: str = "") -> None:
    """Drop what other operators keep, and give back what their arrays left with the allocators: it
    mustn't stand beside the next one's arrays."""
    global _last
    others = [k for k in _kept if k[0] != operator]
    if others or operator != _last:
        _last = operator
        for k in others:
            del _kept[k]
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: its memory is reused, not returned
            pass


def two_columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text): the only columns that go to Python; null texts become empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets start at 0, nothing is copied."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, operator: str = "") -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes of ``text`` each; no empty parts."""
    release(operator)
    for batch in batches:
        if not batch.num_rows:
            continue
        at = 0
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
