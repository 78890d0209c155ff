"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table  # noqa: F401

#: Arrow rows that one step of a Python operator holds at most.
BATCH_ROWS = 2000
#: Bytes of text that a step holds whose arrays take many times the text: two such steps share an executor's memory, and
#: tables of powers stay at two million entries.
SLICE_BYTES = 1_900_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Return freed memory to the system: workers are kept for later stages, and so would be what they once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library


def slices(batches, rows: int = BATCH_ROWS, byte_limit: int = 4 << 20):
    """Split Arrow batches so that one slice has few rows and few bytes (one long row may exceed it)."""
    for batch in batches:
        n = batch.num_rows
        start = 0
        while start < n:
            size = min(rows, n - start)
            while size > 1 and batch.slice(start, size).get_total_buffer_size() and _bytes(batch, start, size) > byte_limit:
                size = max(1, size // 2)
            yield batch.slice(start, size)
            start += size
    give_back()


def _bytes(batch: pa.RecordBatch, start: int, size: int) -> int:
    return batch.slice(start, size).nbytes


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def without(df: DataFrame, names) -> DataFrame:
    """df without the extra columns that an operator's results of these names would clash with."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def shielded(df: DataFrame, names) -> tuple[DataFrame, list]:
    """df with clashing columns renamed, and the columns that give it back from a frame that still has them."""
    taken = {n.lower() for n in names}
    new = [f"__own{i}_{c}" if c.lower() in taken else c for i, c in enumerate(df.columns)]
    return df.toDF(*new), [F.col(n).alias(c) for n, c in zip(new, df.columns)]
