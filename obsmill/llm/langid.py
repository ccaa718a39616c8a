"""Language of texts: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm.frames import importable, lean, named, slices

UNKNOWN, SPACE = "und", 32
BUCKET_BITS, LENGTHS, STEP = 15, (2, 3, 4), 1 << 17
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters and the bytes of other characters stay, everything else parts words.
_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else SPACE for b in range(256))


class Model(NamedTuple):
    """For each bucket what it adds to the score of each language, and how scores become answers."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


class Settings(NamedTuple):
    """How much is learned from, and how.

    The sample holds about `docs_per_language` rows of each of the
    `most_languages` most frequent ones, chosen by a hash of their ids; up to
    `pieces_per_doc` pieces of `piece_bytes` of each are learned from, one doc
    in `calibrate_every` is kept for the calibration instead.  Of those, whole,
    the ones of lowest score are rejected as long as less than a share
    `local_precision` of their answers is right, against what is right in the
    upper half by score, and never more than a share `most_rejected`: wrong
    labels, which stand at any score, can't move the threshold further.  It is
    at least `least_score`, whatever share of documents that rejects.
    """

    docs_per_language: int = 900
    most_languages: int = 200
    most_bytes: int = 1 << 16
    pieces_per_doc: int = 4
    piece_bytes: int = 240
    calibrate_every: int = 5
    dimensions: int = 16
    epochs: int = 6
    batch: int = 64
    rate: float = 0.5
    local_precision: float = 0.75
    most_rejected: float = 0.05
    least_score: float = 0.5


def _prepared(text: str) -> bytes:
    """Words in lower case between single spaces or more, with a space at both ends."""
    return b" " + text.lower().encode().translate(_WORDS) + b" "


def _subwords(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of each run of `size` bytes that has no space but at its ends, and not at both alone."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    space = data == SPACE
    within = np.zeros(count, dtype=bool)
    for i in range(1, size - 1):
        within |= space[i : count + i]
    starts = np.flatnonzero(~within & ~(space[:count] & space[size - 1 :]) if size == 2 else ~within)
    code = np.full(len(starts), size, dtype=np.uint32)
    for i in range(size):
        code = code * np.uint32(0x01000193) ^ data[starts + i]
    code *= np.uint32(0x9E3779B1)
    return starts, (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class _Sums:
    """Adds up the bucket weights of many texts laid end to end."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sum for each text and language, and the number of subwords of each text."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        sums, counts = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for at in range(0, len(data), STEP):
            for size in LENGTHS:
                starts, buckets = _subwords(data[at : at + STEP + size - 1], size)
                owners = np.searchsorted(ends, starts + at, side="right")
                counts += np.bincount(owners, minlength=len(texts))
                for i in range(self.weights.shape[1]):
                    sums[:, i] += np.bincount(owners, self.weights[buckets, i], minlength=len(texts))
        return sums, counts


def _pieces(text: str, settings: Settings, rng: np.random.Generator) -> list[bytes]:
    words = _prepared(text).split()
    pieces, own, size = [], [], 0
    for word in words:
        own.append(word)
        size += len(word) + 1
        if size >= settings.piece_bytes:
            pieces.append(b" " + b" ".join(own) + b" ")
            own, size = [], 0
    if own and (size >= settings.piece_bytes // 4 or not pieces):
        pieces.append(b" " + b" ".join(own) + b" ")
    chosen = rng.permutation(len(pieces))[: settings.pieces_per_doc]
    return [pieces[i] for i in chosen]


def _softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train(examples: list[tuple[str, str]], settings: Settings = Settings()) -> Model:  # noqa: B008
    """Learns from (text, language) pairs; the same pairs in the same order give the same model."""
    rng = np.random.default_rng(8)
    languages = sorted({language for _, language in examples})
    number = {language: i for i, language in enumerate(languages)}
    learned, kept, whole = [], [], []
    for i, (text, language) in enumerate(examples):
        calibrates = i % settings.calibrate_every == settings.calibrate_every - 1
        pieces = [(piece, number[language]) for piece in _pieces(text, settings, rng)]
        (kept if calibrates else learned).extend(pieces)
        if calibrates and pieces:
            whole.append((text, number[language]))
    if not learned:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0), 1.0, 1.0)
    embeddings = rng.uniform(-1, 1, (1 << BUCKET_BITS, settings.dimensions)) / settings.dimensions
    linear, bias = np.zeros((settings.dimensions, len(languages))), np.zeros(len(languages))
    found = []
    for piece, _ in learned:  # every piece has a letter between spaces, so it has subwords
        data = np.frombuffer(piece, dtype=np.uint8)
        found.append(np.concatenate([_subwords(data, size)[1] for size in LENGTHS]))
    wanted = np.array([answer for _, answer in learned])
    steps = settings.epochs * -(-len(learned) // settings.batch)
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(learned))
        for at in range(0, len(order), settings.batch):
            own = order[at : at + settings.batch]
            rate = settings.rate * (1 - step / steps)
            step += 1
            buckets = np.concatenate([found[i] for i in own])
            sizes = np.array([len(found[i]) for i in own])
            begins = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(embeddings[buckets], begins, axis=0) / sizes[:, None]
            error = _softmax(hidden @ linear + bias)
            error[np.arange(len(own)), wanted[own]] -= 1
            back = np.repeat((error @ linear.T) / sizes[:, None], sizes, axis=0)
            linear -= rate * hidden.T @ error
            bias -= rate * error.mean(axis=0)
            for i in range(settings.dimensions):
                embeddings[:, i] -= rate * np.bincount(buckets, back[:, i], minlength=len(embeddings))
    weights = np.einsum("bd,dl->bl", embeddings, linear)
    return _calibrated(languages, weights, bias, kept or learned, whole, settings)


def _calibrated(
    languages: list[str], weights: np.ndarray, bias: np.ndarray, kept: list, whole: list, settings: Settings
) -> Model:
    """Chooses the temperature of least loss on pieces, and the threshold on documents, of texts not learned from."""
    sums, counts = _Sums(weights)([piece for piece, _ in kept])
    scores = sums / np.maximum(counts, 1)[:, None] + bias
    wanted = np.array([answer for _, answer in kept])
    at = np.arange(len(kept))
    losses = {
        t: -np.log(np.maximum(_softmax(scores / t)[at, wanted], 1e-12)).mean() for t in np.geomspace(0.05, 10, 54).tolist()
    }
    # Of temperatures that are as good, the one of the least certain scores.
    temperature = max(t for t, loss in losses.items() if loss <= min(losses.values()) + 1e-3)
    model = Model(languages, weights, bias, temperature, settings.least_score)
    scores, right = [], []
    for text, answer in whole:
        (found,), score = predict(model, [text])
        scores += score.tolist()
        right.append(found == languages[answer])
    return model._replace(threshold=threshold(np.array(scores), np.array(right, dtype=bool), settings))


def threshold(scores: np.ndarray, right: np.ndarray, settings: Settings) -> float:
    """The score from which on answers are accepted, given those of documents and whether they are their labels."""
    order = np.argsort(scores, kind="stable")
    wrong = ~right[order]
    most = int(settings.most_rejected * len(wrong))
    noise = wrong[len(wrong) // 2 :].mean() if most else 0.0
    bound = noise + (1 - noise) * (1 - settings.local_precision)
    # Of the lowest scores, as many are rejected as give the most wrong answers beyond the bound.
    rejected = int(np.concatenate([[0], np.cumsum(wrong[:most] - bound)]).argmax())
    return max(settings.least_score, float(scores[order[rejected]])) if rejected else settings.least_score


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores from 0 to 1; texts without a letter are unknown with the score 0."""
    found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if not known or not model.languages:
        return found, scores
    sums, counts = _Sums(model.weights)([_prepared(texts[i]) for i in known])
    answers = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
    for i, answer, score in zip(known, answers.argmax(axis=1).tolist(), answers.max(axis=1).tolist(), strict=True):
        found[i], scores[i] = model.languages[answer], score
    return found, scores


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: the CRC-32 of their id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"  # noqa: B008
) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out; null ids are not learned from."""
    doc_id, text, lang = F.col(named(id_col)).cast("long"), F.col(named(text_col)).cast("string"), F.col(named(lang_col)).cast("string")
    usable = doc_id.isNotNull() & ~held_out(doc_id) & lang.isNotNull() & text.rlike(r"\p{L}")
    usable &= (lang != UNKNOWN) & (F.octet_length(text) <= settings.most_bytes)
    labelled = docs.where(usable).select(doc_id.alias("doc_id"), lang.alias("lang"), text.alias("text"))
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.most_languages)
    shares = {r.lang: settings.docs_per_language / r.n for r in counted.collect()}
    if not shares:
        return train([], settings)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / (1 << 30)
    chosen = [(F.col("lang") == language) & (draw < share) for language, share in shares.items()]
    rule = chosen[0]
    for other in chosen[1:]:
        rule |= other
    rows = labelled.where(rule).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([(r.text, r.lang) for r in rows], settings)


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "language_id") -> DataFrame:
    """Adds one struct column, `into`, to the documents: language, score, and whether the answer is accepted.

    Null texts and texts without a letter are unknown and not accepted, and so
    are answers below the threshold.  All rows and columns stay; documents
    must not have a column of that name.
    """
    spark = docs.sparkSession
    importable(spark)
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {into}")
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by the number of buckets and languages

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found, scores = [], []
            own = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            for piece in slices(own, "text"):
                languages, values = predict(shared.value, piece.column("text").to_pylist())
                found += languages
                scores += values.tolist()
            frame = pd.DataFrame({"language": found, "score": scores})
            frame["accepted"] = (frame["language"] != UNKNOWN) & (frame["score"] >= shared.value.threshold)
            yield frame

    @F.pandas_udf("language string, score double, accepted boolean")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return lean(each)(batches)

    return docs.withColumn(into, answers(F.col(named(text_col)).cast("string")))
