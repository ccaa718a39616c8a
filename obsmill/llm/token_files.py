"""Token ids of documents as Parquet files that can be read in parts.

A file holds one row per document: its id, the number of its partition, where
its ids start within the partition, how many there are, and the ids as a list.
Ids are dictionary encoded (a vocabulary fits one dictionary page), the sorted
numbers delta encoded.  Row groups and pages are small, and the pages carry an
index, so a range of documents or the counts alone are read without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsmill.llm.byte_tokens import encoder
from obsmill.llm.frames import LONG_SLICE, slices, texts_of

ROW = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", LONG_SLICE):
                ids = [x + end for x in encoder(path).encode(piece.column("text"))]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                columns = [
                    piece.column("doc_id"),
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(start + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(offsets), flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                start += int(offsets[-1])

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 16 << 20,
    page_rows: int = 2_000,
) -> None:
    """Writes the ids of every whole text, ended by `end_id`, in ascending order of ids.

    Null texts count as empty and get the end id alone; null ids come first;
    repeated rows are all written, in the order of the input.  An empty table
    gives a folder without rows.  Other columns are ignored.  Texts move
    through one exchange, and are encoded after it.
    """
    ordered = texts_of(docs, id_col, text_col, row=True)
    ordered = ordered.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows = ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id), ROW)
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }
    rows.write.options(**options).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The written rows; bounds on doc_id and unused columns never leave the files."""
    rows = spark.read.schema(ROW).parquet(folder)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def with_start(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before a row; `every` is the whole written table.

    Only counts are read for it.  The joined side has one row per written
    partition, which is what bounds the broadcast.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = every.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = rows.join(F.broadcast(parts), "part")
    return joined.withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"]
        )


def with_checksum(rows: DataFrame) -> DataFrame:
    """Replaces the ids by the CRC-32 of their little-endian unsigned 32-bit form."""
    schema = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"
    return rows.mapInArrow(_checksums, schema)
