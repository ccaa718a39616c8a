"""Cuts a table into shards of nearly equal bytes by histogram sort.

Rows are sorted by a key that keeps equal texts together.  The cuts are found
without sorting: probe keys are set between the bounds known for each cut, the
exact bytes below each probe are counted over all rows, and the bounds close
in, until every cut meets the tolerance.  Then the rows move, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsmill.llm.frames import importable, stored
from obsmill.sources.workspace import new_folder

#: A key is a hash of the text above so many bits of a hash of the row, so that
#: a cut can pass between texts and, where one text fills shards, within it.
ROW_BITS = 24
BLOCK, TOP = 1 << ROW_BITS, 1 << 63
WRITTEN = "shard int, part int, key long, row long, size long, text_crc32 long, doc_id long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole document and its row number, size, checksum and key; null texts are a text of their own."""
    text = F.col(text_col).cast("string")
    row = F.monotonically_increasing_id()
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("high"),
        row.alias("row"),
    )
    low = F.pmod(F.xxhash64("doc_id", "row"), F.lit(BLOCK))
    key = F.col("high").bitwiseAND(F.lit(-BLOCK)).bitwiseOR(low)
    return whole.withColumn("key", key).drop("high")


def _bytes_below(keys: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the rows whose key is below each of the sorted probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("key").to_numpy(), side="right")
            np.add.at(total, at, batch.column("size").to_numpy())
        used = np.flatnonzero(total)
        columns = [pa.array(used.astype(np.int32)), pa.array(total[used])]
        yield pa.RecordBatch.from_arrays(columns, names=["bin", "bytes"])

    counted = keys.select("key", "size").mapInArrow(run, "bin int, bytes long")
    found = np.zeros(len(probes) + 1, dtype=np.int64)
    for row in counted.groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect():  # one row per probe at most
        found[row.bin] = row.bytes
    return np.cumsum(found)[:-1]


class _Cut:
    """What is known about one cut: bounds on its key, and the bytes below them."""

    def __init__(self, target: float, total: int):
        self.target = target
        self.low, self.high, self.below_low, self.below_high = 0, TOP, 0, total

    def best(self) -> tuple[int, float]:
        """The nearer bound and how far it is off."""
        off = (abs(self.below_low - self.target), abs(self.below_high - self.target))
        return (self.low, off[0]) if off[0] <= off[1] else (self.high, off[1])

    def settled(self, tolerance: float, whole: float) -> bool:
        """A cut between texts may be off by `whole`, to keep equal texts together."""
        key, off = self.best()
        return off <= (whole if key % BLOCK == 0 and self.high - self.low <= BLOCK else tolerance) or self.high - self.low <= 1

    def probes(self, count: int) -> list[int]:
        unit = BLOCK if self.high - self.low > BLOCK else 1
        steps = (self.high - self.low) // unit
        return sorted({self.low + steps * i // (count + 1) * unit for i in range(1, count + 1)} - {self.low})

    def refine(self, probes: list[int], below: list[int]) -> None:
        for key, count in zip(probes, below, strict=True):
            if self.low < key < self.high:
                if count <= self.target:
                    self.low, self.below_low = key, count
                else:
                    self.high, self.below_high = key, count
                    break


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, whole: float = 0.02, probes: int = 63) -> list[int]:
    """Keys at which shards after the first begin.

    `tolerance` and `whole` are shares of a shard's mean bytes.  Where even the
    nearest two keys miss the tolerance, the nearer one is taken.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = [_Cut(total * i / shards, total) for i in range(1, shards)]
    mean = total / shards
    while open_cuts := [c for c in cuts if not c.settled(tolerance * mean, whole * mean)]:
        wanted = sorted({p for c in open_cuts for p in c.probes(probes)})
        below = dict(zip(wanted, _bytes_below(keys, np.array(wanted, dtype=np.int64)).tolist(), strict=True))
        for cut in open_cuts:
            own = [p for p in wanted if cut.low < p < cut.high]
            cut.refine(own, [below[p] for p in own])
    return [c.best()[0] for c in cuts]


def write_shards(docs: DataFrame, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes whole documents to `folder`/shard=0 and so on, with sizes near equal.

    A document's size is its UTF-8 bytes and one more; null texts have none.
    Equal texts share a shard, unless that alone would put it off by more than
    two percent.  Null ids and repeated rows are rows like others; an empty
    table gives no shard.  The document is one nested column, so its columns
    may have any name.
    """
    importable(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    cuts = splitters(stored(rows.select("key", "size"), "shard-keys"), shards)
    shard: Column = reduce(lambda a, b: a + b, [(F.col("key") >= c).cast("int") for c in cuts], F.lit(0))
    dealt = rows.withColumn("shard", shard).repartitionByRange("key", "row")
    ordered = dealt.sortWithinPartitions("shard", "key", "row")
    ordered.withColumn("part", F.spark_partition_id()).write.partitionBy("shard").parquet(folder)


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of written shards; slots count from 0 in each shard."""
    rows = spark.read.schema(WRITTEN).parquet(folder)
    parts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "row")) - 1
    numbered = rows.withColumn("own", own).join(bases, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("own")).alias("slot"))


def shard_table(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards to a new folder of the shared one and gives the place of each document."""
    folder = new_folder(docs.sparkSession, "shards")
    write_shards(docs, folder, shards, id_col, text_col)
    return slots(docs.sparkSession, folder)
