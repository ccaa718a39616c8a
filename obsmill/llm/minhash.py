"""MinHash fingerprints of texts, and near copies by bands of them.

A fingerprint holds, for each of a set of universal hash functions, the lowest
16 bits of the smallest hash among a text's word shingles; the share of equal
places of two fingerprints estimates the Jaccard similarity of the shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm.components import components
from obsmill.llm.frames import slices, stored, texts_of

PLACES, BAND, SHINGLE = 64, 4, 5
_draw = np.random.default_rng(10)
#: Multiply-shift hashing: odd factors and offsets of 64 bits, of whose result the upper half counts.
FACTORS = _draw.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_ORDER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of `size` words; of all words, if there are fewer; none without words.

    Words are what white space separates, in lower case.
    """
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in text.lower().split()], dtype=np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    mixed = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        mixed = mixed * _ORDER + words[i : len(words) - size + 1 + i]
    mixed ^= mixed >> np.uint64(31)
    return mixed * _ORDER


def signature(hashes: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the smallest hash for each function; all bits are set without hashes."""
    least = np.full(PLACES, np.uint64(0xFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        part = (hashes[at : at + 2048] * FACTORS[:, None] + OFFSETS[:, None]) >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return (least & np.uint64(0xFFFF)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shared_bands(a: np.ndarray, b: np.ndarray) -> int:
    """How many bands of two fingerprints are equal; one makes two texts candidates."""
    return int((a == b).reshape(-1, BAND).all(axis=1).sum())


def _range_of(value: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds at or below a value, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    upper = _range_of(value, bounds[middle + 1 :], first + middle + 1)
    return F.when(value >= bounds[middle], upper).otherwise(_range_of(value, bounds[:middle], first))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes rows in order and compares each with the one after it in its range."""
    held: tuple | None = None
    rows: list[tuple] = []
    names = [c.split()[0] for c in COMPARED.split(", ")]

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        for piece in slices(batch, "text"):
            columns = (piece.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text"))
            for span, guest, doc_id, text in zip(*columns, strict=True):
                text = text or ""
                own = signature(shingles(text))
                if held is not None and held[0] == span:
                    rows.append(_row(held, text, own))
                held = None if guest else (span, doc_id, text, own)
            if rows:
                yield flushed()


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_bands long, next_bands long"
)


def _row(held: tuple, after: str, after_signature: np.ndarray) -> tuple:
    _, doc_id, text, own = held
    cut = len(text) // 4
    edited = text[: len(text) - cut] + after[:cut]
    other = signature(shingles(edited))
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        own.tobytes().hex(),
        other.tobytes().hex(),
        likeness(own, other),
        likeness(own, after_signature),
        shared_bands(own, other),
        shared_bands(own, after_signature),
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_ranges: int = 4096) -> DataFrame:
    """The fingerprint of each whole text, and its likeness to an edited copy and to the next document.

    The edited copy has its last quarter of code points replaced by as many (or
    all) of the next document's first ones.  Documents follow each other by id,
    null ids first, repeated ids in the order of the input; the last one is
    followed by the first, a single one by itself.  Null texts count as empty,
    texts without words are alike.  Other columns are ignored.

    Ids are cut into ranges, of which there are as many as shuffle partitions;
    the first document of a range is also sent to the range before it, as the
    one that follows its last.  Texts move once and pass through a task one by
    one.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col, row=True)
    count = min(most_ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fractions = [i / count for i in range(1, count)]
    bounds = rows.agg(F.percentile_approx("doc_id", fractions or [0.5], 100 * count)).first()[0]
    span = F.coalesce(_range_of(F.col("doc_id"), sorted(set(bounds or []))), F.lit(0))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(span))
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row")
    # One row for each range, with the range before it; the first one follows the last.
    firsts = rows.groupBy("range").agg(F.min(order).alias("first")).select("range", "first.doc_id", "first.row").collect()
    places = sorted((r.range, r.row) for r in firsts)
    if not places:
        return spark.createDataFrame([], COMPARED)
    before = [places[-1][0], *(p[0] for p in places[:-1])]
    guests = spark.createDataFrame([(p[1], b) for p, b in zip(places, before, strict=True)], "row long, before int")
    own = rows.withColumn("guest", F.lit(False))
    asked = rows.join(F.broadcast(guests), "row")
    asked = asked.select("doc_id", "text", "row", F.col("before").alias("range"), F.lit(True).alias("guest"))
    dealt = own.select("doc_id", "text", "row", "range", "guest").unionAll(asked)
    ordered = dealt.repartitionById(count, F.col("range")).sortWithinPartitions("range", "guest", "doc_id", "row")
    return ordered.mapInArrow(_compare, COMPARED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, sorted, and its bands."""
    for batch in batches:
        for piece in slices(batch, "text"):
            hashes = [np.unique(shingles(t)) for t in piece.column("text").to_pylist()]
            bands = [signature(h).reshape(-1, BAND).view(np.int64).ravel() for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("node"),
                    pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64())),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["node", "shingles", "bands"],
            )


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _verified(threshold: float):
    """Links of one bucket's texts: each is compared until one text of every group found so far is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, clusters = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("band", "value", "one", "other")), strict=True)
            for own, node, hashes in zip(keys, batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
                if own != key:
                    key, clusters = own, []
                own_set = hashes.values.to_numpy().view(np.uint64)
                apart, joined = [], [(node, own_set)]
                for cluster in clusters:
                    near = next((n for n, h in cluster if _jaccard(h, own_set) >= threshold), None)
                    if near is None:
                        apart.append(cluster)
                    else:
                        found.append((node, near))
                        joined += cluster
                clusters = [*apart, joined]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 2, names=["a", "b"])

    return run


def similar(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2_000
) -> DataFrame:
    """(doc_id, row, class_id) of every row: near copies by word shingles.

    Distinct texts that share a band are candidates, found by grouping on the
    band; their Jaccard similarity decides.  class_id is the smallest id that
    links reach.  Equal texts share a class, so do texts without words; null
    counts as empty.  Shingles move only for texts that have candidates.  A
    bucket beyond `bucket_rows` texts is dealt out as pairs of chunks.
    """
    rows = texts_of(docs, id_col, text_col, row=True).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2("text", 256)
    marked = stored(rows.select("doc_id", "row", digest.alias("digest")), "minhash-rows")
    texts = rows.withColumn("digest", digest).groupBy("digest").agg(F.first("text").alias("text"), F.min("row").alias("node"))
    sets = stored(texts.select("node", "text").mapInArrow(_sets, "node long, shingles array<long>, bands array<long>"), "minhash-sets")
    banded = sets.select("node", F.posexplode("bands").alias("band", "value"))
    crowded = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    dealt = banded.join(crowded, ["band", "value"]).withColumn("chunks", chunks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"one": F.least("own", "with"), "other": F.greatest("own", "with")})
    keys = ["band", "value", "one", "other"]
    full = dealt.select(*keys, "node").join(sets.select("node", "shingles"), "node")
    ordered = full.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, "node")
    stars = components(ordered.mapInArrow(_verified(threshold), "a long, b long"))
    first = marked.groupBy("digest").agg(F.min("row").alias("text_node"), F.min("doc_id").alias("least"))
    rooted = first.join(stars, F.col("text_node") == F.col("node"), "left")
    rooted = rooted.select("digest", "least", F.coalesce("to", "text_node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = rooted.join(best, "root").select("digest", "class_id")
    return marked.join(classes, "digest").select("doc_id", "row", "class_id")
