"""Shared plumbing of the training-data operators: durable intermediate tables, Arrow block iteration."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dropped, released, shared_dir, written

__all__ = ["dropped", "released", "shared_dir", "written"]

#: Bytes of text that one numpy block works on.
BLOCK_BYTES = 2 << 20
#: Rows and bytes of one Arrow batch; with BLOCK_BYTES they bound a Python worker's memory.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long documents must fit in a worker. Spark reads these settings when a query runs, so they stay with the
    session; smaller values of the caller's are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias(col)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array, without copies."""
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _trim() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, and the arrays of one stage shouldn't weigh on the next."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_blocks(batches: Iterator[pa.RecordBatch], col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most limit bytes of text, or one longer document."""
    yield from _cut(batches, col, limit)
    pa.default_memory_pool().release_unused()
    _trim()


def _cut(batches: Iterator[pa.RecordBatch], col: str, limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        _, off = buffers(b.column(b.schema.get_field_index(col)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each bucket of a partition sorted by bucket (columns bucket, blob): one bucket is held at a time."""
    now, held = None, []
    for b in batches:
        for k, blob in zip(column(b, "bucket").to_pylist(), column(b, "blob").to_pylist(), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(blob)
    if held:
        yield now, held
    del held
    pa.default_memory_pool().release_unused()
    _trim()
