"""Removes passages that occur more than once in a corpus, found by suffix sorting.

A text is a row of letters, its bytes or its words, and a window is a string of
`length` letters.  anchors.py gives each window a key that depends on its
letters alone, so equal windows meet under one key, in runs called pieces.
Pieces whose key occurs once need no look.  Of equal pieces one stands for all,
with their number; where every piece of a key occurs again, so does every
window of them.  The other keys' letters are dealt to shards by key; induced.py
sorts the suffixes of a shard, and a window is repeated if a neighbour in that
order shares `length` letters, or if its piece occurs twice.

A key whose pieces would fill a shard by themselves, as those of a passage in
very many surroundings, is parted: by the letters that all windows of a few
neighbouring places share, and where that isn't enough by whole windows, which
then only have to be counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm import anchors
from obsmill.llm.frames import free, give_back, importable, lean, named, slices, stored
from obsmill.llm.induced import suffixes

PIECE = "key long, digest long, width int, row long, start int, twice boolean"
SEGMENT = "key long, digest long, width int, times long, letters binary"
MARK = "key long, digest long, width int, first int, last int"
IDENTITY = ["key", "digest", "width"]
#: Windows of so many neighbouring places share a part of a crowded key.
STEP = 32
_WORDS = re.compile(r"\S+")


class Alphabet(NamedTuple):
    """How a text becomes letters, and how long the runs are that give windows their keys."""

    letters: Callable[[str], np.ndarray]
    gram: int
    size: int


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def _words(text: str) -> np.ndarray:
    """A hash of each word between white space."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, text.split())), dtype=np.uint64)


BYTES, WORDS = Alphabet(_bytes, 128, 1), Alphabet(_words, 16, 8)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pieces(length: int, alphabet: Alphabet):
    size = alphabet.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.column("row").to_numpy()
                texts = [alphabet.letters(text or "") for text in part.column("text").to_pylist()]
                data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
                own = anchors.together(data, ends, length, alphabet.gram)
                raw = data.tobytes()
                bounds = zip((size * own.starts).tolist(), (size * (own.ends + length - 1)).tolist(), strict=True)
                digests = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in bounds], dtype=np.uint64)
                owner = np.searchsorted(ends, own.starts, side="right")
                columns = (
                    own.keys.view(np.int64),
                    digests.view(np.int64),
                    (own.ends - own.starts).astype(np.int32),
                    rows[owner],
                    (own.starts - np.concatenate([[0], ends])[owner]).astype(np.int32),
                    own.repeats,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(PIECE))

    return lean(run)


def _parts(length: int, alphabet: Alphabet, step: int):
    """The parts of given pieces of a text, as pieces with keys of their own; with step 1, each window is one."""
    size = alphabet.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for row, text, crowded in zip(*(part.column(c).to_pylist() for c in ("row", "text", "crowded")), strict=True):
                    data = alphabet.letters(text)
                    raw = data.tobytes()
                    for piece in crowded:
                        start, end = piece["start"], piece["start"] + piece["width"]
                        if step == 1:
                            own = [(at, at + 1, 0, at, at + length) for at in range(start, end)]
                        else:
                            key = piece["key"] & (1 << 64) - 1
                            own = anchors.narrowed(data, key, start, end, length, alphabet.gram, step)
                        for first, last, kind, begin, stop in own:
                            core = xxhash.xxh3_64_intdigest(raw[size * begin : size * stop], kind)
                            digest = xxhash.xxh3_64_intdigest(raw[size * first : size * (last + length - 1)])
                            rows.append((core, digest, last - first, row, first, False))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                signed = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in columns[:2]]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*signed, *(pa.array(c, t) for c, t in zip(columns[2:], kinds, strict=True))], names=_names(PIECE)
                )

    return lean(run)


def _segments(length: int, alphabet: Alphabet):
    """The letters of the pieces that stand for others, from the text of their document."""
    size = alphabet.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    raw = alphabet.letters(text).tobytes()
                    for w in wanted:
                        own = raw[size * w["start"] : size * (w["start"] + w["width"] + length - 1)]
                        rows.append((w["key"], w["digest"], w["width"], w["times"], own))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=_names(SEGMENT))

    return lean(run)


def _string(segments: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One string of small letters for all segments, where their letters begin in it, and how many stand for one.

    Bytes stand for themselves; of words, their rank in the shard's vocabulary is
    written as two letters of different kinds, so that no word begins within
    another; few letters have few queues.  They follow 0,
    the end of the string, and 1, the end of a segment.
    """
    data, each = np.frombuffer(b"".join(segments), dtype=np.uint8 if size == 1 else np.uint64), 1
    if size > 1:
        distinct, rank = np.unique(data, return_inverse=True)
        base, each = max(2, int(np.ceil(np.sqrt(len(distinct))))), 2
        data = np.stack([rank // base, base + rank % base], axis=1).ravel()
    counts = np.array([each * len(s) // size for s in segments])
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    letters = np.ones(int(begins[-1]) + 1, dtype=np.uint16)
    letters[-1] = 0
    inside = np.ones(len(letters), dtype=bool)
    inside[begins[1:] - 1] = inside[-1] = False
    letters[inside] = data.astype(np.uint16) + np.uint16(2)
    return letters, begins, each


def _without_single_words(segments: list[bytes], length: int, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What is left of segments between words that occur once in all of them, if it holds a window; its segment and place there.

    A window with such a word occurs once.
    """
    raw = b"".join(segments)
    _, rank, counts = np.unique(np.frombuffer(raw, dtype=np.uint64), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) // size for s in segments])
    owners = np.repeat(np.arange(len(segments)), np.diff(ends, prepend=0))
    again = np.concatenate([[False], counts[rank] > 1, [False]])
    # A run also ends where its segment does.
    begins = np.flatnonzero(again[1:-1] & (~again[:-2] | (np.diff(owners, prepend=-1) > 0)))
    stops = np.flatnonzero(again[1:-1] & (~again[2:] | (np.diff(owners, append=len(segments)) > 0))) + 1
    long = stops - begins >= length
    begins, stops = begins[long], stops[long]
    parts = [raw[size * a : size * b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
    return parts, owners[begins], begins - np.concatenate([[0], ends])[owners[begins]]


def repeated_windows(segments: list[bytes], times: np.ndarray, length: int, memory: int, size: int = 1) -> tuple[np.ndarray, ...]:
    """(segment, first, last): the runs of starts whose window occurs again in these segments, or as often as given."""
    if size == 1:
        return _windows(segments, times, length, memory, size)
    many = np.flatnonzero(times > 1)
    widths = np.array([len(segments[i]) // size - length + 1 for i in many.tolist()], dtype=np.int64)
    parts, owners, places = _without_single_words(segments, length, size)
    if not parts:
        return many, np.zeros_like(widths), widths
    part, firsts, lasts = _windows(parts, np.ones(len(parts), dtype=int), length, memory, size)
    found = (owners[part], places[part] + firsts, places[part] + lasts)
    return tuple(np.concatenate(x) for x in zip(found, (many, np.zeros_like(widths), widths), strict=True))


def _windows(segments: list[bytes], times: np.ndarray, length: int, memory: int, size: int) -> tuple[np.ndarray, ...]:
    letters, places, each = _string(segments, size)
    order = suffixes(letters, length * each, memory)
    full = order.common >= length * each
    found = np.zeros(len(letters), dtype=bool)
    found[order.places[full | np.append(full[1:], False)]] = True
    counts = np.array([len(s) // size for s in segments])
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    # The place of each letter's first small one; the ends of segments are one small letter.
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], counts + 1)
    repeated = np.append(found[np.repeat(places[:-1], counts + 1) + each * at], False)
    widths = counts - length + 1
    for i in np.flatnonzero(times > 1).tolist():
        repeated[begins[i] : begins[i] + widths[i]] = True
    # A start belongs to a window only if its segment goes on for the window's length.
    bounds = np.zeros(len(repeated), dtype=np.int8)
    bounds[begins[:-1]], bounds[begins[:-1] + widths] = 1, -1
    repeated &= np.cumsum(bounds, dtype=np.int8) > 0
    steps = np.diff(repeated.astype(np.int8), prepend=np.int8(0))
    firsts, lasts = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    owner = np.searchsorted(begins, firsts, side="right") - 1
    return owner, firsts - begins[owner], lasts - begins[owner]


def _sorted_shards(length: int, memory: int, size: int):
    """Takes the segments of one shard after the other and marks the repeated windows of each."""

    def marks(held: list[tuple]) -> pa.RecordBatch:
        owner, firsts, lasts = repeated_windows([h[4] for h in held], np.array([h[3] for h in held]), length, memory, size)
        columns = [pa.array([held[i][c] for i in owner.tolist()], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))]
        ranges = [pa.array(x.astype(np.int32)) for x in (firsts, lasts)]
        return pa.RecordBatch.from_arrays([*columns, *ranges], names=_names(MARK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", *_names(SEGMENT))]
            for own, *segment in zip(*columns, strict=True):
                if own != shard and held:
                    yield marks(held)
                    held = []
                    give_back()
                shard = own
                held.append(tuple(segment))
        if held:
            yield marks(held)

    return lean(run)


def _shared(pieces: DataFrame) -> DataFrame:
    """The pieces whose key occurs more than once."""
    keys = pieces.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    keys = keys.where((F.col("n") > 1) | F.col("twice")).select("key")
    return stored(pieces.join(keys, "key", "left_semi"), "repeat-candidates", compression="zstd")


def _distinct(candidates: DataFrame) -> DataFrame:
    """One of equal pieces, and how many there are."""
    one = F.min(F.struct("row", "start")).alias("one")
    return stored(candidates.groupBy(*IDENTITY).agg(F.count("*").alias("times"), one), "repeat-distinct")


def _open(distinct: DataFrame, weight: Column) -> DataFrame:
    """The keys of pieces that occur once, with the bytes of all their pieces; where each piece occurs again, so does each window."""
    keys = distinct.groupBy("key").agg(F.sum(weight).alias("size"), F.min("times").alias("least"))
    return keys.where(F.col("least") == 1).select("key", "size")


def repeated(texts: DataFrame, length: int, shard_bytes: int = 2 << 20, memory: int = 2 << 20, alphabet: Alphabet = BYTES) -> DataFrame:
    """(row, spans): for rows with repeated windows, the runs of their starts as (first, last).

    Takes (row, text); windows are strings of the alphabet's letters.  A shard
    has about `shard_bytes`, and no key has more, unless in one whole window.
    Queues beyond `memory` bytes wait on disk.  A document's pieces and spans
    are as many as its length allows; nothing else is gathered.
    """
    size = alphabet.size
    candidates = _shared(stored(texts.mapInArrow(_pieces(length, alphabet), PIECE), "repeat-pieces", compression="zstd"))
    distinct = _distinct(candidates)
    weight = (F.col("width").cast("long") + (length - 1)) * size
    for step in (STEP, 1):
        crowded = stored(_open(distinct, weight).where(F.col("size") > shard_bytes).select("key"), "repeat-crowded")
        if crowded.isEmpty():
            break
        own = candidates.join(crowded, "key", "left_semi").groupBy("row")
        own = own.agg(F.collect_list(F.struct("key", "start", "width")).alias("crowded"))
        parts = texts.join(own, "row").select("row", "text", "crowded").mapInArrow(_parts(length, alphabet, step), PIECE)
        parted = _shared(stored(parts, "repeat-pieces", compression="zstd"))
        candidates = stored(candidates.join(crowded, "key", "left_anti").unionAll(parted), "repeat-candidates", compression="zstd")
        distinct = _distinct(candidates)
    keys = _open(distinct, weight).select("key", F.lit(True).alias("open"))
    distinct = stored(distinct.join(keys, "key", "left"), "repeat-open")
    unknown, settled = distinct.where("open"), distinct.where("open is null")
    total = unknown.agg(F.sum(weight)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    wanted = F.collect_list(F.struct(F.col("one.start").alias("start"), *IDENTITY, "times")).alias("wanted")
    by_row = unknown.groupBy(F.col("one.row").alias("row")).agg(wanted)
    segments = texts.join(by_row, "row").select("text", "wanted").mapInArrow(_segments(length, alphabet), SEGMENT)
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    ordered = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "key")
    every = settled.select(*IDENTITY, F.lit(0).alias("first"), F.col("width").alias("last"))
    marks = stored(ordered.mapInArrow(_sorted_shards(length, memory, size), MARK).unionAll(every), "repeat-marks")

    found = candidates.join(marks, IDENTITY)
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return found.select("row", span.alias("span")).groupBy("row").agg(F.collect_list("span").alias("spans"))


def word_runs(text: str, spans: list, words: int) -> list[tuple[int, int]]:
    """The bytes of the words that windows with these starts among the words cover, as runs in order."""
    own = merged([(s["first"], s["last"] + words - 1) for s in spans])
    if not own:
        return []
    places = [m.span() for m in _WORDS.finditer(text)]
    at, size, runs = 0, 0, []
    for first, last in own:
        begin, end = places[first][0], places[last - 1][1]
        size += len(text[at:begin].encode())
        runs.append((size, size := size + len(text[begin:end].encode())))
        at = end
    return runs


def covered(spans: list, length: int) -> list[tuple[int, int]]:
    """The bytes that windows with these starts cover, as maximal runs in order."""
    return merged([(s["first"], s["last"] + length - 1) for s in spans])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs in order of ranges that overlap or touch."""
    runs: list[list[int]] = []
    for first, last in sorted(ranges):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs]


def kept(data: bytes, runs: list[tuple[int, int]], whole_characters: bool) -> bytes:
    """What is left without the runs; characters that are covered in part stay, if wanted."""
    out, at = [], 0
    for first, last in runs:
        if whole_characters:
            while first < last and data[first] & 0xC0 == 0x80:
                first += 1
            while last > first and last < len(data) and data[last] & 0xC0 == 0x80:
                last -= 1
        out.append(data[at:first])
        at = last
    return b"".join([*out, data[at:]])


def without_repeats(
    docs: DataFrame,
    length: int = 400,
    text_col: str = "text",
    into: str = "left",
    words: int | None = None,
) -> DataFrame:
    """All rows and columns, and a struct column `into`: n_bytes, n_removed, n_spans, kept, n_passage_bytes and rest.

    Every byte goes that a string of `length` bytes covers which also starts
    elsewhere, in the same text or another; strings are judged on the input,
    and never cross texts.  `kept` are the remaining bytes.  Null and short
    texts stay as they are (null has no bytes); of repeated rows nothing is
    left if they are long enough.  `rest` is the remaining text when, with
    `words`, passages of so many words that start elsewhere go too, however
    short, with the white space between two words that go; n_passage_bytes are the bytes of both
    kinds of passages.  UTF-8 characters that are covered in part stay in it,
    and null stays null.  An existing column `into` is replaced, others may
    have any name.
    """
    importable(docs.sparkSession)
    row, spans, worded = free(docs, "row_number"), free(docs, "spans"), free(docs, "word_spans")
    text = F.col(named(text_col)).cast("string")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = repeated(texts, length).select(F.col("row").alias(row), F.col("spans").alias(spans))
    none = F.lit(None).cast(found.schema[spans].dataType)
    if words:
        passages = repeated(texts, words, alphabet=WORDS)
        passages = passages.select(F.col("row").alias(row), F.col("spans").alias(worded))

    def left(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, spans, worded in batches:
            rows = []
            for text, own, by_words in zip(texts, spans, worded, strict=True):
                data = (text or "").encode()
                runs = covered(own, length) if own is not None else []
                every = merged(runs + word_runs(text, by_words, words)) if by_words is not None else runs
                sizes = [sum(b - a for a, b in x) for x in (runs, every)]
                rest = None if text is None else kept(data, every, True).decode() if every else text
                rows.append((len(data), sizes[0], len(runs), kept(data, runs, False), sizes[1], rest))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "n_passage_bytes", "rest"])

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, n_passage_bytes long, rest string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return lean(left)(batches)

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    joined = numbered.join(found, row, "left")
    joined = joined.join(passages, row, "left") if words else joined.withColumn(worded, none)
    return joined.withColumn(into, cut(text, F.col(spans), F.col(worded))).drop(row, spans, worded)
