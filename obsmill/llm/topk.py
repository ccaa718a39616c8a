"""Exact inner-product search over vectors sorted by length.

Vectors are rotated into the principal directions of the whole table, so that
the first few components hold most of a product.  What the others can add is
bounded by the lengths of the rests (Cauchy-Schwarz).  The block of the longest
vectors goes first and gives each query a score that its best ones must reach;
a block of candidates too short for that meets no block of queries.  A task
takes the others by descending length against a block of queries, keeps the best
so far for each query, and works out only the products whose bound reaches them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsmill.llm.frames import importable, stored

SCALE, STEP = 1024, 512
LAST_ID = np.iinfo(np.int64).max
NO_SCORE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
VECTOR = "vec_id long, row long, length double, vector array<double>"
BLOCK = "part int, block int, vec_ids array<long>, rows array<long>, vectors array<double>, longest double"
FOUND = "query_row long, query_id long, row long, vec_id long, score long"
FLOORS = "query_part int, query_block int, floors array<long>, need double"


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of whole numbers; those that are null or hold a null or non-finite component go."""
    for batch in batches:
        ids, rows, lengths, vectors = [], [], [], []
        for vec_id, row, value in zip(*(batch.column(c) for c in ("vec_id", "row", "vector")), strict=True):
            if not value.is_valid or value.values.null_count:
                continue
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(whole).all():
                ids.append(vec_id.as_py())
                rows.append(row.as_py())
                lengths.append(_length(whole))
                vectors.append(whole)
        columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(lengths, pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(vectors, pa.list_(pa.float64()))], names=["vec_id", "row", "length", "vector"]
        )


def _length(vector: np.ndarray) -> float:
    """The length, which is infinite only if it isn't a double itself."""
    most = np.abs(vector).max(initial=0)
    with np.errstate(over="ignore"):
        return float(most * np.sqrt(((vector / most) ** 2).sum())) if most else 0.0


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width))
    flat, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _rotation(vectors: DataFrame, width: int, longest: float) -> np.ndarray:
    """The right singular vectors of the whole table, largest singular value first, from its width x width Gram matrix.

    Vectors count in units of the longest one, so that no square overflows.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = _matrix(batch.column("vector"), width) / (longest or 1.0)
            total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "value"])

    cells = vectors.select("vector").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(width * width)
    for row in cells.collect():  # width x width numbers, however many vectors there are
        total[row.cell] = row.value
    values, directions = np.linalg.eigh(total.reshape(width, width))
    return directions[:, np.argsort(-values)]


def _packed(size: int, width: int):
    """Blocks of up to `size` consecutive vectors, numbered within the partition."""
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                own = batch.slice(at, size)
                matrix = _matrix(own.column("vector"), width)
                columns = [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([own.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([own.column("row").to_pylist()], pa.list_(pa.int64())),
                    pa.array([matrix.ravel()], pa.list_(pa.float64())),
                    pa.array([float(own.column("length")[0].as_py())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                block += 1

    return run


class _Best:
    """The best k of a block of queries so far: scores, ids and rows, best first.

    `floors` are scores that k others are known to reach (NO_SCORE: unknown).
    """

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int, rotation: np.ndarray, floors: np.ndarray | None = None):
        self.queries, self.own, self.k, self.rotation = queries, rows, k, rotation
        shape = (len(queries), k)
        self.floors = np.full(len(queries), NO_SCORE) if floors is None else floors
        self.scores = np.full(shape, NO_SCORE)
        self.ids = np.full(shape, LAST_ID)
        self.rows = np.full(shape, -1, dtype=np.int64)
        self.turned = queries @ rotation
        width = rotation.shape[0]
        self.depths = sorted({max(1, width // 4), max(1, width // 2), width})
        self.lengths = np.array([_length(x) for x in queries])

    def worst(self) -> np.ndarray:
        """What a score must reach to be among the best of each query."""
        known = np.maximum(self.scores[:, -1], self.floors)
        return np.where(known == NO_SCORE, -np.inf, known.astype(np.float64))

    def need(self) -> float:
        """The least length of a vector that may enter the best of some query."""
        worst = self.worst()
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(worst <= 0, 0.0, worst / self.lengths)
        return float(least.min(initial=np.inf)) * (1 - 1e-9)

    def _may_enter(self, vectors: np.ndarray) -> np.ndarray:
        """Which candidates may be among the best of some query, by bounds from more and more components."""
        worst, alive, lengths = self.worst()[:, None], np.arange(len(vectors)), np.array([_length(x) for x in vectors])
        if not max(self.lengths.max(initial=0), lengths.max(initial=0)) < 1e100:
            return alive  # bounds might overflow
        turned = vectors @ self.rotation
        partial, done = np.zeros((len(self.queries), len(vectors))), 0
        slack = 1e-9 * np.outer(self.lengths, lengths) + 1e-6
        for depth in self.depths:
            partial = partial + self.turned[:, done:depth] @ turned[alive, done:depth].T
            rest = [np.sqrt((x[:, depth:] ** 2).sum(axis=1)) for x in (self.turned, turned[alive])]
            fits = (partial + np.outer(*rest) + slack[:, alive] >= worst).any(axis=0)
            alive, partial, done = alive[fits], partial[:, fits], depth
            if not len(alive):
                break
        return alive

    def take(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(vectors), STEP):
            own = vectors[at : at + STEP]
            alive = self._may_enter(own)
            if not len(alive):
                continue
            scores = _products(self.queries, own[alive])
            near_ids, near_rows = ids[at : at + STEP][alive], rows[at : at + STEP][alive]
            itself = self.own[:, None] == near_rows[None, :]
            scores[itself] = NO_SCORE
            self._merge(scores, near_ids, np.where(itself, -1, near_rows[None, :]))

    def _merge(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        count = len(self.queries)
        scores = np.concatenate([self.scores, scores], axis=1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (count, len(ids)))], axis=1)
        rows = np.concatenate([self.rows, rows], axis=1)
        order = np.lexsort((rows, ids, ~scores), axis=1)[:, : self.k]
        self.scores, self.ids, self.rows = (np.take_along_axis(x, order, axis=1) for x in (scores, ids, rows))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; one beyond their range is the outermost of them."""
    most = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    with np.errstate(over="ignore"):
        reach = most[0] * most[1] * a.shape[1]
    if reach < 2.0**53:  # doubles hold all sums exactly
        return (a @ b.T).astype(np.int64)
    whole = max(most) < 2.0**63 and reach < 2.0**100
    if whole:
        out, near = a.astype(np.int64) @ b.astype(np.int64).T, np.abs(a @ b.T)
    else:
        out, near = np.empty((len(a), len(b)), dtype=np.int64), np.full((len(a), len(b)), np.inf)
    # Integers wrap, so sums that fit are right; those that might not are added as Python integers.
    rows, columns = {}, {}
    for i, j in np.argwhere(near >= 2.0**62).tolist():
        left = rows.get(i) or rows.setdefault(i, [int(x) for x in a[i].tolist()])
        right = columns.get(j) or columns.setdefault(j, [int(x) for x in b[j].tolist()])
        out[i, j] = max(-MOST, min(MOST, sum(x * y for x, y in zip(left, right, strict=True))))
    return out


def _of(row: pa.RecordBatch, width: int, k: int, rotation: np.ndarray, floors: bool) -> _Best:
    queries = row.column("queries")[0].values.to_numpy().reshape(-1, width)
    known = np.array(row.column("floors")[0].as_py(), dtype=np.int64) if floors else None
    return _Best(queries, np.array(row.column("query_rows")[0].as_py(), dtype=np.int64), k, rotation, known)


def _meet(best: _Best, row: pa.RecordBatch, width: int) -> None:
    ids = np.array([LAST_ID if x is None else x for x in row.column("vec_ids")[0].as_py()], dtype=np.int64)
    vectors = row.column("vectors")[0].values.to_numpy().reshape(-1, width)
    best.take(vectors, ids, np.array(row.column("rows")[0].as_py(), dtype=np.int64))


def _floors(k: int, width: int, rotation: np.ndarray):
    """For each block of queries, what its best must reach after the block of the longest vectors."""
    names = [c.split()[0] for c in FLOORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                best = _of(row, width, k, rotation, floors=False)
                _meet(best, row, width)
                columns = [row.column("query_part"), row.column("query_block")]
                columns += [pa.array([best.scores[:, -1]], pa.list_(pa.int64())), pa.array([best.need()])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _search(k: int, width: int, rotation: np.ndarray):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def rows_of(query_ids: list, best: _Best) -> pa.RecordBatch:
        found = best.rows >= 0
        query, _ = np.nonzero(found)
        ids = best.ids[found]
        columns = [
            pa.array(best.own[query]),
            pa.array([query_ids[i] for i in query.tolist()], pa.int64()),
            pa.array(best.rows[found]),
            pa.array(ids, mask=ids == LAST_ID),
            pa.array(best.scores[found]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query_ids, best = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = tuple(row.column(c)[0].as_py() for c in ("query_part", "query_block", "part"))
                if own != key:
                    if best is not None:
                        yield rows_of(query_ids, best)
                    key, query_ids = own, row.column("query_ids")[0].as_py()
                    best = _of(row, width, k, rotation, floors=True)
                if row.column("longest")[0].as_py() >= best.need():
                    _meet(best, row, width)
        if best is not None:
            yield rows_of(query_ids, best)

    return run


def search(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 2048,
    query_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k best for each row whose id is divisible by `every`.

    Components become floor(1024 * x).  Candidates are all other rows; ties go
    to the smaller id, null ids last, then to the earlier row.  A repeated id
    is a query and a candidate for each of its rows.  Vectors that are null or
    hold a null or non-finite component, as given or times 1024, take no part; shorter ones are filled
    with zeros, so vectors without components score 0.  A score beyond 64 bits
    is the outermost long of its sign.  An empty table has no result.  Other
    columns are ignored.
    """
    importable(vectors.sparkSession)
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    scaled = stored(named.mapInArrow(_scaled, VECTOR), "topk-vectors")
    width, longest = scaled.agg(F.max(F.size("vector")), F.max("length")).first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long, query_row long")
    width = max(width, 1)
    rotation = _rotation(scaled, width, longest)

    by_length = scaled.repartitionByRange(F.desc("length"), F.asc("row")).sortWithinPartitions(F.desc("length"), F.asc("row"))
    candidates = stored(by_length.mapInArrow(_packed(block_rows, width), BLOCK), "topk-blocks")
    asked = scaled.where(F.col("vec_id") % every == 0).mapInArrow(_packed(query_rows, width), BLOCK)
    asked = stored(asked, "topk-queries")
    names = {"part": "query_part", "block": "query_block", "vec_ids": "query_ids", "rows": "query_rows", "vectors": "queries"}
    queries = asked.drop("longest").withColumnsRenamed(names)
    # One block of the longest vectors meets every block of queries first.
    first = candidates.agg(F.min_by("part", F.struct("part", "block")), F.min_by("block", F.struct("part", "block"))).first()
    longest_block = candidates.where((F.col("part") == first[0]) & (F.col("block") == first[1]))
    known = queries.repartition("query_part", "query_block").join(F.broadcast(longest_block))
    known = stored(known.mapInArrow(_floors(k, width, rotation), FLOORS), "topk-floors")
    # Each block of queries meets each block of candidates that may enter: the stated queries against all rows.
    places = known.select("query_part", "query_block", "need")
    pairs = places.join(candidates, F.col("longest") >= F.col("need")).drop("need")
    pairs = pairs.join(queries, ["query_part", "query_block"]).join(known.drop("need"), ["query_part", "query_block"])
    order = ["query_part", "query_block", "part"]
    ordered = pairs.repartition(*(F.col(c) for c in order)).sortWithinPartitions(*order, "block")
    found = ordered.mapInArrow(_search(k, width, rotation), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")
