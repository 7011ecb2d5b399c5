"""What the corpus operators share: tables, and byte views of Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.storage import shared_dir, written

__all__ = ["byte_view", "partitions", "parts", "read", "set_aside", "restored", "shared_dir", "slices", "strings", "trim", "written"]

_LIBC = ctypes.CDLL(None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def set_aside(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _body and the other columns in one, _rest: whatever their names, they don't clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    return docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_body"), F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))


def restored(rows: DataFrame, docs: DataFrame, key: str, text: str, body: Column | None = None) -> DataFrame:
    """The columns of docs again, from rows with those of set_aside(); the text as it was, or another one."""
    at = {key: F.col("_id"), text: F.col("_body") if body is None else body}
    return rows.select(*((at[c] if c in at else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array, and n + 1 offsets into it; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Gives memory that a worker's last task, or a fit in the driver, has freed back to the machine: both go on with other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that `column` has at most about `limit` bytes in each.

    A longer single text is a slice of its own; an empty batch is left out.
    """
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = byte_view(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch, cut so that a binary `column` has about `limit` bytes in each; a longer value is a part of its own."""
    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k > start and size + n > limit:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)
