"""Near copies by fast similarity sketches of word shingles, banded, and confirmed on the full sets.

A sketch throws all elements of a set into its bins, round by round, with a new
hash function in each.  A bin keeps its smallest hash of the first round that
reaches it, and rounds end when no bin is empty; after as many random rounds as
there are bins, each further round fills one given bin.  So every coordinate is
filled, elements of large sets are hashed about once, and the share of equal
coordinates estimates the Jaccard similarity as closely as that of independent
permutations.

Sets that agree in a band of coordinates are candidates.  A band's bucket never
becomes all its pairs: first each set meets the smallest sets of the buckets
that it shares most bands with, and what is confirmed is joined to components.
Then only buckets of several components are looked at, where every set outside
the largest one meets all others, unless a link has joined them meanwhile; the
links of a forest leave a task.  All links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsmill.llm.components import components
from obsmill.llm.frames import slices, stored, texts_of

# Fixed value: lower case of A-Z alone.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Coordinates of a sketch, a power of two, and how many make a band: at a similarity of 0.85 a pair shares none
#: of the 32 bands with a probability of 5e-11, and of 0.8 with 5e-8.
BINS, BAND = 128, 4
#: Sets of a bucket are compared if their sketches agree within so many standard deviations of the threshold.
DEVIATIONS = 5
#: Sets are compared by 32 bits of each hash, so a similarity is known to this; what is nearer to the threshold joins nothing yet.
DOUBT = 0.001
#: The smallest sets of so many buckets are tried first.
CENTRES = 3
_ORDER, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, 2 * BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = BINS.bit_length() - 1
_VALUE = np.uint64(64 - _BITS)
MARKED = "doc_id long, row long, n_shingles int, digest binary, bands array<long>, sketch binary"
PAIR = "a long, b long"
HELD = ("node", "root", "chunk", "bands", "sketch", "short")


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of `size` words, sorted; of all words, if there are fewer; none without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    size = min(size, len(hashes))
    mixed = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ mixed >> np.uint64(29)) * _ORDER + hashes[i : len(hashes) - size + 1 + i]
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed * _ORDER)


def _round(elements: np.ndarray, seed: np.uint64) -> np.ndarray:
    mixed = (elements ^ elements >> np.uint64(32)) * seed
    mixed ^= mixed >> np.uint64(29)
    mixed *= _SPREAD
    return mixed ^ mixed >> np.uint64(32)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS coordinates for each set; sets must not be empty.

    A coordinate is the smallest hash of its bin in the first round that
    reaches it, mixed with the round, so equal coordinates mean, but for chance,
    the same element in the same round.
    """
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    empty = np.ones((len(sets), BINS), dtype=bool)
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for number, seed in enumerate(_SEEDS):
        if not len(elements):
            break
        hashes = _round(elements, seed)
        bins = (hashes >> _VALUE).astype(np.int64) if number < BINS else np.full(len(hashes), number - BINS)
        places = owners * BINS + bins
        fits = empty.ravel()[places]
        least = np.full(out.size, ~np.uint64(0))
        np.minimum.at(least, places[fits], hashes[fits])
        filled = np.unique(places[fits])
        out.ravel()[filled] = least[filled] * _ORDER + seed
        empty.ravel()[filled] = False
        # A set whose bins are full after a round is done.
        going = empty.any(axis=1)[owners]
        elements, owners = elements[going], owners[going]
    return out


def _marked(size: int):
    """For each text the size and digest of its set, its bands and, in two bytes a coordinate, its sketch."""
    names = [c.split()[0] for c in MARKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = [shingles(t, size) for t in piece.column("text").to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                bands, shorts = [None] * len(sets), [None] * len(sets)
                for at in range(0, len(some), 64):
                    own = some[at : at + 64]
                    found = sketches([sets[i] for i in own])
                    grouped = found.reshape(len(own), -1, BAND)
                    mixed = np.zeros(grouped.shape[:2], dtype=np.uint64)
                    for i in range(BAND):
                        mixed = (mixed ^ mixed >> np.uint64(29)) * _ORDER + grouped[:, :, i]
                    # Bands of different places never meet.
                    mixed = (mixed + np.arange(mixed.shape[1], dtype=np.uint64)) * _SPREAD
                    short = (found >> np.uint64(48)).astype("<u2")
                    for i, band, own_short in zip(own, mixed.view(np.int64).tolist(), short, strict=True):
                        bands[i], shorts[i] = band, own_short.tobytes()
                columns = [
                    piece.column("doc_id"),
                    piece.column("row"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(shorts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _short(size: int):
    """The upper 32 bits of the hashes of each text's set, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = [np.unique((shingles(t, size) >> np.uint64(32)).astype("<u4")) for t in piece.column("text").to_pylist()]
                columns = [piece.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "short"])

    return run


class _Cell:
    """Two chunks of a bucket, or one: the sets of the first, all outside the bucket's largest component, meet the others."""

    def __init__(self, place: int, one: int, other: int, held: list[tuple], threshold: float):
        self.place, self.threshold = place, threshold
        self.nodes, self.labels, self.chunks = (np.array([h[i] for h in held]) for i in range(3))
        self.bands = np.array([h[3] for h in held])
        self.prints = np.frombuffer(b"".join([h[4] for h in held]), dtype="<u2").reshape(len(held), BINS)
        self.sets = [np.frombuffer(h[5], dtype="<u4") for h in held]
        self.sizes = np.array([len(s) for s in self.sets])
        self.asking, self.asked = np.flatnonzero(self.chunks == one), self.chunks == other
        self.alone = one == other
        self.least = BINS * threshold - DEVIATIONS * (BINS * threshold * (1 - threshold)) ** 0.5

    def _candidates(self, i: int) -> np.ndarray:
        """Sets of other components that may be similar to one, the likeliest first; each pair in the first band it shares."""
        fits = self.asked & (self.labels != self.labels[i])
        fits &= (self.sizes >= (self.threshold - DOUBT) * self.sizes[i]) & ((self.threshold - DOUBT) * self.sizes <= self.sizes[i])
        if self.alone:
            fits &= self.nodes > self.nodes[i]
        others = np.flatnonzero(fits)
        others = others[(self.bands[others] == self.bands[i]).argmax(axis=1) == self.place]
        equal = (self.prints[others] == self.prints[i]).sum(axis=1)
        likely = equal >= self.least
        return others[likely][np.argsort(-equal[likely], kind="stable")]

    def links(self) -> Iterator[tuple[int, int]]:
        for i in self.asking.tolist():
            for j in self._candidates(i).tolist():
                if self.labels[i] == self.labels[j]:
                    continue
                both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                likeness = both / (self.sizes[i] + self.sizes[j] - both)
                if likeness >= self.threshold - DOUBT:
                    yield min(a := int(self.nodes[i]), b := int(self.nodes[j])), max(a, b)
                if likeness >= self.threshold + DOUBT:
                    self.labels[self.labels == self.labels[j]] = self.labels[i]


def _forest(threshold: float):
    """Takes the sets of one cell after the other and gives the pairs that join its components."""

    def links(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        found = list(_Cell(*key[1:], held, threshold).links())
        columns = list(zip(*found, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("band", "place", "one", "other", *HELD))
            for band, place, one, other, *own in zip(*columns, strict=True):
                if (band, place, one, other) != key and held:
                    yield links(key, held)
                    held = []
                key = (band, place, one, other)
                held.append(tuple(own))
        if held:
            yield links(key, held)

    return run


def _confirmed(size: int, share: int, whole: int):
    """The pairs whose sets are similar, told by all their elements; a set that many pairs need is made once in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            for a, b, one, other in zip(*columns, strict=True):
                if known[0] != a:
                    known = (a, shingles(one, size))
                mine, yours = known[1], shingles(other, size)
                both = len(np.intersect1d(mine, yours, assume_unique=True))
                if whole * both >= share * (len(mine) + len(yours) - both):
                    found.append((a, b))
            columns = list(zip(*found, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, share: int, whole: int, each: int = 256) -> DataFrame:
    """The pairs (a, b) of texts (node, text) with whole * intersection >= share * union.

    A text that many pairs need is copied once for each `each` of them.
    """
    many, often = (pairs.groupBy(c).agg(F.ceil(F.count("*") / each).cast("int").alias("parts")) for c in ("a", "b"))
    one, other = (_copied(texts, counts, c) for counts, c in ((many, "a"), (often, "b")))
    dealt = _dealt(_dealt(pairs, often, "b", "a"), many, "a", "b")
    # The last join leaves the pairs of a text next to each other.
    full = dealt.join(other, ["b", "part_b"]).join(one, ["a", "part_a"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(size, share, whole), PAIR)


def _copied(texts: DataFrame, counts: DataFrame, node: str) -> DataFrame:
    own = texts.select(F.col("node").alias(node), F.col("text").alias(f"text_{node}")).join(counts, node)
    return own.withColumn(f"part_{node}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _dealt(pairs: DataFrame, counts: DataFrame, node: str, other: str) -> DataFrame:
    """Deals the pairs of a text to its copies; only those of several are joined, which are few."""
    several = counts.where(F.col("parts") > 1)
    parts = F.coalesce("parts", F.lit(1))
    return pairs.join(several, node, "left").withColumn(f"part_{node}", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")


def groups(
    docs: DataFrame,
    size: int = 3,
    share: int = 85,
    whole: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 1 << 20,
) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) for every row.

    A text's set are its distinct runs of `size` words, A-Z in lower case,
    words parted by ASCII white space; with fewer words all of them are one
    run.  Documents are linked if whole * intersection >= share * union of
    their sets; component_id is the smallest doc_id that links reach, null
    where all ids are, and kept tells whether it is the row's own.  Null texts
    and texts without words have no set and are linked with nothing.  Rows of
    equal sets are linked, repeated rows too, and those of one id are all kept
    or none.  An empty table gives no rows; other columns are ignored.

    Candidates are found by bands and compared by sketches, so a link may be
    missed by the chance that BAND and DEVIATIONS state; none is dropped
    otherwise.  Of a bucket with several components, sets are dealt to chunks
    of so many shingles, and a task holds two chunks at a time.
    """
    threshold = share / whole
    rows = texts_of(docs, id_col, text_col, row=True)
    marked = stored(rows.mapInArrow(_marked(size), MARKED), "sketch-rows", compression="zstd")
    firsts = marked.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node")).select("node")
    each = marked.withColumnRenamed("row", "node").join(firsts, "node", "left_semi").drop("doc_id")
    each = stored(each, "sketch-sets", compression="zstd")

    banded = each.select("node", "n_shingles", F.posexplode("bands").alias("place", "band"))
    centre = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where(F.col("n") > 1)
    members = stored(banded.join(centre.drop("n"), "band"), "sketch-members", compression="zstd")
    votes = members.where(F.col("node") != F.col("centre")).groupBy("node", "centre").agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "centre"))
    tried = votes.withColumn("best", best).where(F.col("best") <= CENTRES)
    nodes = members.select("node").distinct()
    texts = rows.select(F.col("row").alias("node"), "text").join(nodes, "node", "left_semi")
    texts = stored(texts, "sketch-texts", compression="zstd")

    pairs = stored(tried.select(F.col("centre").alias("a"), F.col("node").alias("b")), "sketch-pairs")
    links = stored(confirmed(pairs, texts, size, share, whole), "sketch-links")
    joining = _joining(members, components(links), each, texts.mapInArrow(_short(size), "node long, short binary"), threshold, chunk)
    pairs = stored(joining.distinct(), "sketch-pairs")
    roots = components(links.unionAll(confirmed(pairs, texts, size, share, whole)))

    rooted = each.join(roots, "node", "left").select("digest", F.coalesce("to", "node").alias("root"))
    owned = marked.select("doc_id", "row", "n_shingles", "digest").join(rooted, "digest", "left")
    least = owned.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    told = owned.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return told.select("doc_id", "row", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _joining(members: DataFrame, roots: DataFrame, each: DataFrame, short: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(a, b): pairs that join the components within the buckets that have several."""
    rooted = members.select("band", "place", "node", "n_shingles").join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("to", "node")).drop("to")
    weight = F.sum(F.col("n_shingles").cast("long") + BINS).alias("weight")
    held = rooted.groupBy("band", "root").agg(weight)
    main = F.max_by("root", F.struct("weight", "root")).alias("main")
    mixed = held.groupBy("band").agg(main, F.max("weight").alias("most"), F.sum("weight").alias("all"), F.count("*").alias("several"))
    parts = [F.ceil(w / chunk).cast("int").alias(n) for w, n in ((F.col("all") - F.col("most"), "outer"), (F.col("most"), "inner"))]
    mixed = mixed.where(F.col("several") > 1).select("band", "main", *parts)

    # Chunks of sets outside come first.  A cell is one of them with itself, a later one, or one of the largest component.
    dealt = rooted.join(mixed, "band")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    inside = F.col("root") == F.col("main")
    dealt = dealt.withColumn("chunk", F.when(inside, F.col("outer") + own("inner")).otherwise(own("outer")))
    before = F.transform(F.sequence(F.lit(0), F.least("chunk", F.col("outer") - 1)), lambda one: F.struct(one.alias("one"), F.col("chunk").alias("other")))
    after = F.sequence(F.col("chunk"), F.col("outer") + F.col("inner") - 1)
    after = F.transform(after, lambda other: F.struct(F.col("chunk").alias("one"), other.alias("other")))
    cells = F.when(inside, before).otherwise(F.array_union(before, after))
    dealt = dealt.withColumn("cell", F.explode(cells)).select("band", "place", "node", "root", "chunk", "cell.one", "cell.other")
    full = dealt.join(each.select("node", "bands", "sketch"), "node").join(short, "node")
    key = ("band", "place", "one", "other")
    return full.select(*key, *HELD).repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(_forest(threshold), PAIR)
