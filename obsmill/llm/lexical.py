"""Ranks all documents for each item of a query table by weighted term counts, from the texts themselves.

No index of the documents is built.  The terms of the items go into an
Aho-Corasick automaton, each between two guards, so that a match is a whole
term; a text, with everything that belongs to no term turned into guards, is
read once and its matches are counted.  An automaton output is a term, which
maps to the items that hold it.  Two reads of the corpus are needed: the first
counts documents, terms and document frequencies, the second scores, as weights
depend on all documents.

Items are taken in blocks of bounded size, each with its own automaton, so what
is broadcast does not grow with the query table.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsmill.llm.frames import named, slices, texts_of

GUARD = " "
#: ASCII digits, letters in lower case, and the bytes of other characters stay; all else parts terms.
_TERMS = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Fixed values of the score: the share of a document's length in its measure, in percent, and scales.
LENGTH_SHARE, WEIGHT_SCALE, COUNT_SCALE, COUNT_STEP, MEASURE_STEP = 75, 1000, 1_000_000_000, 1000, 8
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
COUNTED = "term int, documents long, terms long"
FOUND = "item int, doc_id long, row long, score long"
LAST_ID = np.iinfo(np.int64).max


def normal(text: str) -> bytes:
    """A text's terms between guards."""
    return b" " + text.encode().translate(_TERMS) + b" "


def letters(data: bytes) -> str:
    """UTF-8 bytes as one letter each, which is what the automaton reads."""
    return data.decode("latin-1")


class Block(NamedTuple):
    """Some items: the terms they hold, and for each term the items and how often they hold it."""

    items: list
    terms: list[str]
    postings: list[list[tuple[int, int]]]


def blocks(items: list[tuple], most_terms: int, most_items: int) -> Iterator[Block]:
    """Items in blocks of so many items and terms at most; an item of more terms is a block of its own."""
    held: list[tuple] = []
    known: set[str] = set()
    for item, text in items:
        own = Counter(map(letters, normal(text or "").split()))
        if held and (len(held) == most_items or len(known | own.keys()) > most_terms):
            yield _block(held, known)
            held, known = [], set()
        held.append((item, own))
        known |= own.keys()
    if held:
        yield _block(held, known)


def _block(held: list[tuple], known: set[str]) -> Block:
    terms = sorted(known)
    number = {t: i for i, t in enumerate(terms)}
    postings: list[list[tuple[int, int]]] = [[] for _ in terms]
    for i, (_, own) in enumerate(held):
        for term, count in own.items():
            postings[number[term]].append((i, count))
    return Block([item for item, _ in held], terms, postings)


class Scanner:
    """Counts the terms of a block in texts."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(GUARD + term + GUARD, i)
        if terms:
            self.automaton.make_automaton()
        self.any = bool(terms)

    def __call__(self, text: str) -> tuple[int, Counter]:
        """How many terms a text has, and how often each of the block's."""
        guarded = normal(text)
        found = Counter(map(itemgetter(1), self.automaton.iter(letters(guarded)))) if self.any else Counter()
        return len(guarded.split()), found


_scanners: dict[str, Scanner] = {}


def _scanner(shared: Broadcast) -> Scanner:
    """The worker's automaton of a broadcast block; the last few are kept."""
    if shared.value[0] not in _scanners:
        if len(_scanners) > 2:
            _scanners.clear()
        _scanners[shared.value[0]] = Scanner(shared.value[1].terms)
    return _scanners[shared.value[0]]


def _counts(shared: Broadcast):
    """For each of a block's terms the task's documents that hold it; at -1 its documents with terms, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, holding, documents, terms = _scanner(shared), Counter(), 0, 0
        for batch in batches:
            for piece in slices(batch, "text"):
                for text in piece.column("text").to_pylist():
                    if text:
                        count, found = scan(text)
                        holding.update(found.keys())
                        documents += count > 0
                        terms += count
        columns = [[-1, *holding.keys()], [documents, *holding.values()], [terms, *[0] * len(holding)]]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "documents", "terms"])

    return run


class _Best:
    """The best k documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores, self.ids = np.zeros((items, k), dtype=np.int64), np.full((items, k), LAST_ID)
        self.rows = np.full((items, k), LAST_ID)

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores: one row for each document, one column for each item."""
        for item in np.flatnonzero((scores.max(axis=0) >= self.scores[:, -1]) & (scores.max(axis=0) > 0)).tolist():
            own = np.flatnonzero((scores[:, item] >= self.scores[item, -1]) & (scores[:, item] > 0))
            merged = [np.concatenate([a[item], b]) for a, b in ((self.scores, scores[own, item]), (self.ids, ids[own]), (self.rows, rows[own]))]
            order = np.lexsort((merged[2], merged[1], -merged[0]))[: self.k]
            self.scores[item], self.ids[item], self.rows[item] = (m[order] for m in merged)


def _scored(shared: Broadcast, k: int):
    """The best k of the task's documents for each item of a block, by weights that are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, block, weights, documents, terms = shared.value
        scan, best = _scanner(shared), _Best(len(block.items), k)
        sizes = np.array([len(p) for p in block.postings], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        items = np.array([i for own in block.postings for i, _ in own], dtype=np.int64)
        times = np.array([n for own in block.postings for _, n in own], dtype=np.int64)
        weighted = times * np.repeat(np.array(weights, dtype=np.int64), sizes)
        for batch in batches:
            for piece in slices(batch, "text"):
                scores = np.zeros((piece.num_rows, len(block.items)), dtype=np.int64)
                for at, text in enumerate(piece.column("text").to_pylist()):
                    count, found = scan(text) if text else (0, None)
                    if not found:
                        continue
                    measure = 100 - LENGTH_SHARE + LENGTH_SHARE * count * documents // terms
                    own = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
                    held = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                    value = COUNT_SCALE * held // (COUNT_STEP * held + MEASURE_STEP * measure)
                    each = sizes[own]
                    ends = np.cumsum(each)
                    place = np.arange(ends[-1]) + np.repeat(begins[own] - ends + each, each)
                    added = weighted[place] * np.repeat(value, each)
                    # Sums of doubles are exact while all of them stay below 2^53.
                    if int(added.max()) * len(found) < EXACT:
                        scores[at] = np.bincount(items[place], added, minlength=len(block.items)).astype(np.int64)
                    else:
                        np.add.at(scores[at], items[place], added)
                rows = piece.column("row").to_numpy()
                ids = np.array([LAST_ID if i is None else i for i in piece.column("doc_id").to_pylist()], dtype=np.int64)
                best.take(scores, ids, rows)
        item, place = np.nonzero(best.scores)
        ids = best.ids[item, place]
        columns = [
            pa.array(item.astype(np.int32)),
            pa.array(ids, mask=ids == LAST_ID),
            pa.array(best.rows[item, place]),
            pa.array(best.scores[item, place]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "row", "score"])

    return run


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    most_terms: int = 200_000,
    most_items: int = 2_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII, in whole texts; of these A-Z are lower-cased.  Nulls have no
    terms.  Every row is a document, repeated ids too; rows of equal score and
    id come in the order of the input, which must be a stable scan, and null
    ids last.  Repeated items are each answered.  Tables without rows, and
    items without terms, have no result.  Other columns are ignored.

    Items are read block by block on the driver, which holds one block of
    `most_items` items; a block with its automaton is broadcast.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col, row=True)
    asked = queries.select(F.col(named(item_col)).cast("long").alias("item_id"), F.col(named(query_col)).cast("string").alias("text"))
    result: DataFrame | None = None
    for block in blocks(((r.item_id, r.text) for r in asked.toLocalIterator()), most_terms, most_items):
        counting = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        summed = rows.select("text").mapInArrow(_counts(counting), COUNTED).groupBy("term")
        summed = summed.agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()  # a row for each term of the block
        holding = {r.term: r.documents for r in summed}
        documents, terms = holding.get(-1, 0), sum(r.terms for r in summed)
        weights = [weight(documents, holding.get(i, 0)) for i in range(len(block.terms))]
        scoring = spark.sparkContext.broadcast((*counting.value, weights, documents, terms))
        found = rows.mapInArrow(_scored(scoring, k), FOUND)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(block.items)), "item int, item_id long")
        own = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        result = own if result is None else result.unionAll(own)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if result is None else result


def weight(documents: int, holding: int) -> int:
    """The weight of a term that so many of all documents with terms hold."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))
