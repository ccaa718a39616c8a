"""Packs tokenised documents into sequences of one capacity with little padding.

A document is cut into full sequences and one remainder.  The histogram of the
remainders goes to the driver (at most capacity - 1 numbers), where cutting.py
finds patterns; a remainder's place in its pattern follows from its rank among
the remainders of its length.  What rounding leaves over, at most a few pieces
for each pattern, is strung together and cut at the capacity; the end of that
string is cut into powers of two, which need no padding.

Ranks need no sort: each task numbers its own rows, and the tasks' counts are
added up.  So a length that a third of all documents share stays spread out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsmill.llm import cutting
from obsmill.llm.byte_tokens import encoder
from obsmill.llm.frames import LONG_SLICE, give_back, lean, slices, stored, texts_of

FAST = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
TOKENS = "doc_id long, part int, remainder int, local_rank long, local_full long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def _encode(path: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full = TaskContext.get().partitionId(), 0
        wide = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        seen = np.zeros(capacity, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text", LONG_SLICE):
                ids = [
                    np.frombuffer(x + end, dtype="<u4") for x in encoder(path).encode(piece.column("text"))
                ]
                counts = np.array([len(x) for x in ids], dtype=np.int64)
                rest, ranks = counts % capacity, np.zeros(len(ids), dtype=np.int64)
                for i, r in enumerate(rest):
                    ranks[i] = seen[r]
                    seen[r] += 1
                before = full + np.concatenate([[0], np.cumsum(counts // capacity)])
                full = int(before[-1])
                columns = [
                    piece.column("doc_id"),
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(rest.astype(np.int32)),
                    pa.array(ranks),
                    pa.array(before[:-1]),
                    pa.array(counts),
                    pa.array([x.astype(wide).tobytes() for x in ids], pa.binary()),
                ]
                names = [c.split()[0] for c in TOKENS.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del ids, columns  # a slice's ids aren't held while the next one is encoded
                give_back()

    return lean(run)


class Layout(NamedTuple):
    """Where the remainders go.  Arrays by length are indexed by the length.

    For a length, `starts[length]` are the ranks at which its patterns begin, `places[length]`
    their (copies, first sequence, offset); ranks from `covered[length]` on lie
    in the string, whose part for the length begins at `string[length]`.
    """

    capacity: int
    starts: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    covered: np.ndarray
    string: np.ndarray
    string_sequence: int
    cuts: np.ndarray


def layout(counts: np.ndarray, capacity: int, full: int) -> Layout:
    """Turns whole uses of patterns into ranks, sequences and the string of what is left."""
    found = cutting.plan(counts, capacity)
    first = full + np.concatenate([[0], np.cumsum(found.uses)]).astype(np.int64)
    covered = np.zeros(capacity, dtype=np.int64)
    starts: dict[int, list[int]] = {}
    places: dict[int, list[tuple[int, int, int]]] = {}
    for pattern, length, copies, offset in found.rows.tolist():
        starts.setdefault(length, []).append(int(covered[length]))
        places.setdefault(length, []).append((copies, int(first[pattern]), offset))
        covered[length] += found.uses[pattern] * copies
    left = (counts - covered) * np.arange(capacity)
    string = np.concatenate([[0], np.cumsum(left)])
    # The end of the string becomes one sequence for each power of two in its length.
    end, at, cuts = int(string[-1]), int(string[-1]) // capacity * capacity, []
    for bit in reversed(range(capacity.bit_length())):
        if (end % capacity) >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return Layout(
        capacity,
        {k: np.array(v) for k, v in starts.items()},
        {k: np.array(v) for k, v in places.items()},
        covered,
        string[:-1],
        int(first[-1]),
        np.array(cuts, dtype=np.int64),
    )


def _in_string(plan: Layout, at: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(sequence, offset, length) of the pieces of a remainder that begins at `at` of the string."""
    whole = int(plan.cuts[0]) // plan.capacity if len(plan.cuts) else None
    while length:
        sequence, offset = divmod(at, plan.capacity)
        end = (sequence + 1) * plan.capacity
        if sequence == whole:
            i = int(np.searchsorted(plan.cuts, at, side="right"))
            end = int(plan.cuts[i])
            begin = int(plan.cuts[i - 1]) if i else sequence * plan.capacity
            sequence, offset = sequence + i, at - begin
        take = min(length, end - at)
        yield plan.string_sequence + sequence, offset, take
        at, length = at + take, length - take


def _place(plan: Layout, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
    if rank >= plan.covered[length]:
        at = int(plan.string[length]) + (rank - int(plan.covered[length])) * length
        yield from _in_string(plan, at, length)
        return
    i = int(np.searchsorted(plan.starts[length], rank, side="right")) - 1
    copies, sequence, offset = (int(x) for x in plan.places[length][i])
    use, copy = divmod(rank - int(plan.starts[length][i]), copies)
    yield sequence + use, offset + copy * length, length


def _cut(plan: Layout, wide: str, keep_ids: bool):
    capacity = plan.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for piece in slices(batch, "ids"):
                rows: list[tuple] = []
                ids_out: list[np.ndarray] = []
                for doc_id, rest, rank, full, raw in zip(
                    *(piece.column(c).to_pylist() for c in ("doc_id", "remainder", "rank", "full", "ids")), strict=True
                ):
                    ids = np.frombuffer(raw, dtype=wide).astype("<u4")
                    count = len(ids)
                    spots = [(full + i, 0, capacity) for i in range(count // capacity)]
                    if rest:
                        spots += _place(plan, rest, rank)
                    start = 0
                    for sequence, offset, length in spots:
                        own = ids[start : start + length]
                        rows.append((doc_id, start, length, zlib.crc32(own), count, sequence, offset))
                        if keep_ids:
                            ids_out.append(own.astype(np.int32))
                        start += length
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                lists = pa.array(ids_out if keep_ids else [None] * len(rows), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=names)

    return lean(run)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: its document, place in the document, ids, sequence and place in it.

    Null texts count as empty and are one token, the end id; null ids stay
    null; each of repeated rows is packed; long texts are cut into full
    sequences; an empty table has no pieces.  Other columns are ignored.
    With keep_ids=False the list of ids is null and only its checksum is given.
    """
    spark = docs.sparkSession
    encoded = texts_of(docs, id_col, text_col).mapInArrow(_encode(tokenizer, end_id, capacity), TOKENS)
    tokens = stored(encoded, "pack-tokens", **FAST)

    # One row for each task and length: counts, then their running sums over the tasks.  They are few, and so are their files.
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(
        tokens.groupBy("part", "remainder").agg(
            F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("full")
        ).coalesce(files),
        "pack-cells",
    )
    histogram = cells.groupBy("remainder").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()
    counts = np.zeros(capacity, dtype=np.int64)
    for row in histogram:  # at most `capacity` rows
        counts[row.remainder] = row.n if row.remainder else 0
    plan = layout(counts, capacity, sum(row.full for row in histogram))

    parts = cells.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select("part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_base"))
    by_length = earlier.partitionBy("remainder").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("part", "remainder", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("rank_base"))
    bases = bases.join(parts, "part")
    placed = tokens.join(bases, ["part", "remainder"]).select(
        "doc_id",
        "remainder",
        (F.col("rank_base") + F.col("local_rank")).alias("rank"),
        (F.col("full_base") + F.col("local_full")).alias("full"),
        "ids",
    )
    wide = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    return placed.mapInArrow(_cut(plan, wide, keep_ids), PIECES)
