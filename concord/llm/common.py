"""What the operators of this subpackage share: tables, bounded Arrow batches, canonical text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that a task works on at once. A single longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows that a task works on at once.
SLICE_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if v is None else v for v in column.to_pylist()]


def slices(
    batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in slices that hold a bounded number of rows and of bytes in column `name`."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = total = 0
        for at, size in enumerate(sizes):
            if at > start and (total + size > max_bytes or at - start >= max_rows):
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`run`, and behind it the memory that its task has used goes back to the system: workers live on for other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)
