"""SimHash fingerprints, and near copies by a Gray-ordered index of them.

Distinct fingerprints within the bit distance must agree on some of the blocks
that their bits are cut into; so each goes to one exchange bucket for every
choice of blocks, the masked bit pattern that is its uppermost node.  Within a
bucket, fingerprints are sorted by their rank in Gray order, which puts those
of few differing bits together.  Nodes over runs of that order hold the bits
that all below share; two nodes whose shared bits differ too much are passed
over with all that is below them.  A bucket gives links of a forest, not all
pairs; a bucket beyond a size is dealt out as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm.components import components
from obsmill.llm.frames import lean, slices, stored, texts_of

# Lower case of A-Z alone, and the seed of the shingles' XXH64.
LOWER, SEED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), 42
LEAF, FAN, SPARE_BLOCKS = 64, 8, 2


def fingerprint(text: str | None, shingle: int) -> int:
    """The bits set in over half of the hashes of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    lasts = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, lasts, strict=False)]
    counts, size = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, size, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp) of every whole text; fp is the fingerprint as a signed long, null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = np.array([fingerprint(t, shingle) for t in piece.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("row"), pa.array(found.view(np.int64))], names=["doc_id", "row", "fp"]
                )

    return texts_of(docs, id_col, text_col, row=True).mapInArrow(lean(run), "doc_id long, row long, fp long")


def _masks(distance: int) -> list[int]:
    """Choices of blocks such that any two fingerprints within the distance agree on one choice."""
    count = min(64, distance + SPARE_BLOCKS)
    bounds = [round(64 * i / count) for i in range(count + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, count - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the components that the links join; a label is the smallest member."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        la, lb = la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped


class _Node:
    """One level of the index: for each node the bits that all below it share, and their values."""

    def __init__(self, shared: np.ndarray, value: np.ndarray):
        self.shared, self.value = shared, value

    @classmethod
    def over(cls, shared: np.ndarray, value: np.ndarray, size: int) -> _Node:
        starts = np.arange(0, len(value), size)
        first = np.repeat(value[starts], np.diff([*starts, len(value)]))
        differing = np.bitwise_or.reduceat((value ^ first) | ~shared, starts)
        return cls(~differing, value[starts] & ~differing)

    def near(self, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
        """Whether what is below two nodes may be within the distance."""
        differ = (self.value[a] ^ self.value[b]) & self.shared[a] & self.shared[b]
        return np.bitwise_count(differ) <= distance


def _below(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of pairs of nodes, each pair once."""
    x = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, axis=2).ravel()
    y = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, axis=1).ravel()
    fit = (x <= y) & (y < count)
    return x[fit], y[fit]


def _search(fps: np.ndarray, distance: int, labels: np.ndarray, base: int) -> np.ndarray:
    """Merges the labels from `base` on of one bucket's fingerprints, sorted in Gray order."""
    everything = np.full(len(fps), ~np.uint64(0))
    levels = [_Node.over(everything, fps, LEAF)]
    while len(levels[-1].value) > 1:
        levels.append(_Node.over(levels[-1].shared, levels[-1].value, FAN))
    todo = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > 4096:
            half = len(a) // 2
            todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
        elif level:
            x, y = _below(a, b, len(levels[level - 1].value))
            near = levels[level - 1].near(x, y, distance)
            x, y = x[near], y[near]
            order = np.argsort(y - x, kind="stable")
            todo.append((level - 1, x[order], y[order]))
        else:
            labels = _leaves(fps, distance, labels, base, a, b)
    return labels


def _leaves(fps: np.ndarray, distance: int, labels: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Compares the fingerprints of pairs of lowest nodes, unless all of them are linked already."""
    size = len(fps)
    for at in range(0, len(a), 128):
        x, y = a[at : at + 128], b[at : at + 128]
        left = np.minimum(x[:, None] * LEAF + np.arange(LEAF), size - 1)
        right = np.minimum(y[:, None] * LEAF + np.arange(LEAF), size - 1)
        both = np.concatenate([labels[base + left], labels[base + right]], axis=1)
        apart = (both != both[:, :1]).any(axis=1)
        left, right = left[apart], right[apart]
        near = np.bitwise_count(fps[left][:, :, None] ^ fps[right][:, None, :]) <= distance
        pair, i, j = np.nonzero(near)
        labels = _hook(labels, base + left[pair, i], base + right[pair, j])
    return labels


def linked(starts: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the place of the smallest one it is linked to, directly or not, within its bucket.

    Buckets begin at `starts`; each is sorted in Gray order.
    """
    labels = np.arange(len(fps))
    sizes = np.diff([*starts, len(fps)])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= LEAF, sizes)
    for lag in range(1, min(LEAF, int(sizes.max(initial=1)))):
        a = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & small[lag:])
        if len(a):
            near = np.bitwise_count(fps[a] ^ fps[a + lag]) <= distance
            labels = _hook(labels, a[near], a[near] + lag)
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        labels = _search(fps[start : start + size], distance, labels, start)
    return labels


def _links_of(distance: int, at_least: int = 200_000):
    """Reads buckets one after the other, whole, and gives a forest of links within each."""

    def forest(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        labels = linked(starts, fps, distance)
        child = np.flatnonzero(labels != np.arange(len(fps)))
        pair = (pa.array(x.view(np.int64)) for x in (fps[child], fps[labels[child]]))
        return pa.RecordBatch.from_arrays(list(pair), names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "pattern", "one", "other")], axis=1)
            held.append((own, batch.column("fp").to_numpy().view(np.uint64)))
            count += batch.num_rows
            if count < at_least:
                continue
            keys, fps = np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([fps, *(h[1] for h in held)])
            held, count = [], 0
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield forest(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        keys, fps = np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([fps, *(h[1] for h in held)])
        if len(fps):
            yield forest(keys, fps)

    return lean(run)


def links(fps: DataFrame, distance: int, bucket_rows: int = 100_000) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within the distance.

    A bucket of more than `bucket_rows` becomes several chunks, and a task gets
    two chunks at a time, each with each other, so no task holds more than two.
    """
    nodes = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(_masks(distance))]
    spread = fps.select("fp", F.explode(F.array(*nodes)).alias("node")).select("fp", "node.*")
    crowded = spread.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    chunks = F.coalesce(F.ceil(F.col("n") / bucket_rows), F.lit(1)).cast("int")
    dealt = spread.join(crowded, ["mask", "pattern"], "left").withColumn("chunks", chunks)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = {"one": F.least("own", "with"), "other": F.greatest("own", "with")}
    keys = ["mask", "pattern", "one", "other"]
    dealt = dealt.withColumns(pair).select(*keys, "fp", _gray_rank(F.col("fp")).alias("gray"))
    ordered = dealt.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, "gray")
    return ordered.select(*keys, "fp").mapInArrow(_links_of(distance), "a long, b long")


def groups(
    docs: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = 100_000,
) -> DataFrame:
    """(doc_id, row, fp, component_id, keep) for every row.

    Documents are linked if their fingerprints differ in `distance` bits at
    most; component_id is the smallest id that links reach, null only where all
    ids are; keep marks one row of each component, the first one of that id.
    Null and empty texts have the fingerprint 0, repeated rows are linked as
    any others.  Other columns are ignored.
    """
    marked = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    each = stored(marked.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    stars = components(links(each.select("fp"), distance, bucket_rows))
    rooted = each.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("to", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("first"))
    owner = rooted.select("fp", "root").join(best, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row"))
    keep = (F.col("row") == F.col("kept_row")).alias("keep")
    return marked.join(owner, "fp").select("doc_id", "row", "fp", "component_id", keep)
