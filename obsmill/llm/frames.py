"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.session import importable
from obsmill.sources.workspace import stored

__all__ = ["LONG_SLICE", "free", "give_back", "importable", "lean", "named", "quoted", "slices", "stored", "texts_of"]

#: A worker handles so many rows or text bytes of an Arrow batch at a time.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Where equal words are looked up once for a slice, it may be longer.
LONG_SLICE = (4096, 8 << 20)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """(doc_id long, text string), other columns left out, so none can clash.

    With `row`, a number that tells repeated rows apart.  It depends on how the
    input is split, so the input must be a stable scan such as Parquet files.
    """
    importable(docs.sparkSession)
    columns = [F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text")]
    return docs.select(*columns, *([F.monotonically_increasing_id().alias("row")] if row else []))


def quoted(df: DataFrame) -> list[Column]:
    """All columns of a table as they are, whatever their names."""
    return [F.col(named(c)) for c in df.columns]


def named(column: str) -> str:
    """A column name as Spark reads it, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Returns to the system what this worker has freed: Arrow's pool, and the heap where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work, after which the worker holds no freed memory; workers outlive their tasks, and stages their memory."""

    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def slices(batch: pa.RecordBatch, text_col: str, most: tuple[int, int] = (SLICE_ROWS, SLICE_BYTES)) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and few text bytes; a row is never cut."""
    at, count = 0, batch.num_rows
    column = batch.column(batch.schema.get_field_index(text_col))
    while at < count:
        take, size = 0, 0
        while at + take < count and take < most[0] and (take == 0 or size < most[1]):
            value = column[at + take]
            size += value.as_buffer().size if value.is_valid else 0
            take += 1
        yield batch.slice(at, take)
        at += take
