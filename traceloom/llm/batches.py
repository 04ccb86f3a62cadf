"""Helpers for Arrow functions: columns that pass through, and rows gathered to batches of like bytes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def added(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """Schema of df with fields appended; a column of df with such a name gives way."""
    names = {n.lower() for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in fields])


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts hold about `limit` bytes together; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Hands freed memory back to the system, as several tasks' workers and a JVM share an executor's."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = {n.lower() for n in columns}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in names]
    pairs = kept + list(columns.items())
    return pa.RecordBatch.from_arrays([a for _, a in pairs], names=[n for n, _ in pairs])
