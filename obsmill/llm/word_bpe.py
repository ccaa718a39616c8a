"""Byte-pair encoding of words with an end mark, by a walk over the trie of distinct words.

Byte-pair merging has a local property: a sequence of tokens is the encoding of
a word exactly if each token encodes to itself and each two neighbours encode
to themselves when put together.  So the encoding of every prefix of a word is
given by its last token and the encoding of the shorter prefix before it, and
the state of a trie node is that last token alone.  A depth-first walk over the
distinct words, which is their sorted order, computes it once for every shared
prefix.  Which tokens can be the last one follows from the longest end of the
prefix that begins a token, which the walk carries along as an automaton over
the vocabulary would.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsmill.llm.frames import give_back, lean, slices, texts_of
from obsmill.llm.pieces import Known, cut, joined
from obsmill.session import small_batches

# White space other than the space, by the widest notion of it, and normalised pieces
# whose words are plain: letters, then signs that begin no contraction.
_SPACE = re.compile(r"[^\S ]")
_SIMPLE = re.compile(r"([a-z]+)([!-&(-/:-@\[-`{-~]+)?")
ENCODED = "doc_id long, ids array<int>, decoded string"
#: Words and pieces of more bytes are not remembered, so what is remembered is bounded in bytes.
LONG = 128
#: Rows and text bytes of a slice, whose new words are Python objects while their ids are found.
SLICE = (2048, 2 << 20)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 ones as they are, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The vocabulary of a tokenizer file and what follows from its merges."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.longest = max(len(self._letters(t)) for t in self.ids)
        # Tokens whose letters encode to them; the others never come up.
        self.usable = {t for t in self.ids if self._merged(self._symbols(t)) == [t]}
        # Of prefixes of usable tokens: a text's longest end that is one decides which tokens end there.
        self.prefixes = {t[:i] for t in map(self._letters, self.usable) for i in range(len(t) + 1)}
        self._beside: dict[tuple[str, str], bool] = {}
        self._rights: dict[str, list[tuple[str, int, int, int]]] = {}
        self._lefts: dict[str, list[tuple[str, int, int, int]]] = {}
        self._links: dict[str, str] = {}
        self._ending: dict[str, tuple[list[str], list[str]]] = {}

    def _letters(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token

    def _symbols(self, token: str) -> list[str]:
        letters = list(self._letters(token))
        letters[-1] += token[len(letters) :]
        return letters

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def follow(self, held: str, letter: str) -> str:
        """The longest end of a text that is a prefix of usable tokens, given that of the text without its last letter."""
        text = held + letter
        if text in self.prefixes:
            return text
        known = self._links.get(text)
        if known is None:
            if len(self._links) > 200_000:
                self._links.clear()
            known = text
            while known not in self.prefixes:
                known = known[1:]
            self._links[text] = known
        return known

    def ending(self, held: str) -> tuple[list[str], list[str]]:
        """The usable tokens at the end of a text, the longest first, within a word and at its end."""
        known = self._ending.get(held)
        if known is None:
            if len(self._ending) > 200_000:
                self._ending.clear()
            ends = [held[i:] for i in range(len(held))]
            known = self._ending[held] = ([t for t in ends if t in self.usable], [t + self.end for t in ends if t + self.end in self.usable])
        return known

    def last_token(self, tokens: list[str], depth: int, last: list[str], extra: int) -> str:
        """The last token of a prefix of `depth` letters, of those that end there, given the last tokens of all shorter prefixes.

        `extra` letters of a token are its end mark.
        """
        beside = self._beside
        for token in tokens:
            start = depth + extra - len(token)
            if not start:
                return token
            left = last[start]
            fits = beside.get((left, token))
            if fits or fits is None and self.beside(left, token):
                return token
        raise ValueError(f"the vocabulary has no token at letter {depth} of a word")

    def _edge(self, token: str, right: bool) -> list[tuple[str, int, int, int]]:
        """How the symbol at one end of a usable token grows from a letter to the token: (symbol, when it is there, when it is taken up, by which rank).

        A merge comes about once its rank is the least of all that wait, so a
        symbol is there after the highest rank of the merges within it.
        """
        symbols = self._symbols(token)
        grown = [(symbols[-1 if right else 0], -1)]
        highest = [-1] * len(symbols)
        taken = []
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            when = max(rank, highest[at], highest[at + 1])
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            highest = [*highest[:at], when, *highest[at + 2 :]]
            if at == (len(symbols) - 1 if right else 0):
                taken.append((when, rank))
                grown.append((symbols[-1 if right else 0], when))
        taken.append((1 << 60, 1 << 60))
        return [(symbol, since, *until) for (symbol, since), until in zip(grown, taken, strict=True)]

    def beside(self, left: str, right: str) -> bool:
        """Whether the letters of two tokens encode to these two.

        They do if no merge across the border comes before both symbols at it
        have become the tokens; of equal ranks the leftmost comes first.
        """
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > 400_000:
                self._beside.clear()
            known = self._beside[key] = self._apart(left, right)
        return known

    def _apart(self, left: str, right: str) -> bool:
        if self.end and left.endswith(self.end):
            return self._merged([*self._symbols(left), *self._symbols(right)]) == [left, right]
        edges = []
        for token, kept, is_left in ((left, self._rights, True), (right, self._lefts, False)):
            if token not in kept:
                kept[token] = self._edge(token, is_left)
            edges.append(kept[token])
        ours, theirs = edges
        i = j = 0
        while True:
            one, since, until, by = ours[i]
            other, also, to, through = theirs[j]
            rank = self.ranks.get((one, other))
            if rank is not None:
                across = (max(since, also, rank), rank)
                if across < (until, by) and across <= (to, through):
                    return False
            if i + 1 == len(ours) and j + 1 == len(theirs):
                return True
            if (until, by) <= (to, through):
                i += 1
            else:
                j += 1


def encodings(words: list[str], merges: Merges) -> Iterator[list[str]]:
    """The tokens of each of the sorted words; that order is a depth-first walk over their trie.

    held[d] and last[d] tell of the prefix of d letters: which end of it begins
    a token, and its last token.
    """
    held, last, before = [""], [""], ""
    extra, prefixes, follow, ending, last_token = len(merges.end), merges.prefixes, merges.follow, merges.ending, merges.last_token
    for word in words:
        depth = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            depth += 1
        del held[depth + 1 :], last[depth + 1 :]
        now = held[depth]
        for letter in word[depth:]:
            text = now + letter
            now = text if text in prefixes else follow(now, letter)
            held.append(now)
        for depth in range(len(last), len(word)):
            last.append(last_token(ending(held[depth])[0], depth, last, 0))
        before, tokens, depth = word, [], len(word)
        if word:
            tokens.append(last_token(ending(now)[1], depth, last, extra))
            depth -= len(tokens[0]) - extra
        while depth:
            tokens.append(last[depth])
            depth -= len(last[depth])
        yield tokens[::-1]


class WordEncoder:
    """Encodes and decodes texts; remembers the ids of up to `most` pieces between spaces, and of as many words, but of no long ones."""

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["decoder"] is not None:
            raise ValueError("only files without a decoder are known here: tokens are joined by a space")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merges = Merges(spec["model"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")" if self.added else r"(?!)()")
        self.letters = _byte_letters()
        self.pieces, self.words = Known(most, LONG, self._learn), Known(most, LONG, self._merge)
        spoken = [""] * (1 + max([*self.merges.ids.values(), *self.added.values()]))
        for token, i in (self.merges.ids | self.added).items():
            spoken[i] = token
        #: What each id is decoded to, after a space, and then the same without.
        self.spoken = pa.array([*(f" {t}" for t in spoken), *spoken], pa.large_string()).cast(pa.large_binary())

    def _split(self, normal: str) -> list[str]:
        """The words of normalised text, in the letters of their bytes."""
        simple = _SIMPLE.fullmatch(normal)
        if simple:
            return [w for w in simple.groups() if w]
        found = self.pattern.findall(normal)
        return [w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()]) for w in found]

    def _words(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece; added tokens, which are not normalised, come after a space, which no word holds."""
        normal = self.tokenizer.normalizer.normalize_str
        plain = [bool(p) and not self.cut.search(p) and not _SPACE.search(p) for p in pieces]
        # No letter is joined across a space, so one call does for all pieces without other white space.
        whole = iter(normal(" ".join([p for p, is_plain in zip(pieces, plain, strict=True) if is_plain])).split(" "))
        found = []
        for piece, is_plain in zip(pieces, plain, strict=True):
            if is_plain:
                found.append(self._split(next(whole)))
            else:
                parts = self.cut.split(piece)
                found.append([w for p in parts for w in ([f" {p}"] if p in self.added else self._split(normal(p)))])
        return found

    def _learn(self, pieces: list[str]) -> pa.Array:
        """The ids of pieces, by those of their words."""
        found = self._words(pieces)
        begins = np.concatenate([[0], np.cumsum([len(ws) for ws in found], dtype=np.int64)])
        return self.words.strung(pa.array([w for ws in found for w in ws], pa.large_string()), begins)

    def _merge(self, words: list[str]) -> pa.Array:
        """The ids of words."""
        ids, special = self.merges.ids.__getitem__, {f" {t}": array("i", [i]).tobytes() for t, i in self.added.items()}
        found = [special.get(w, b"") for w in words]
        order = sorted((i for i, w in enumerate(words) if w not in special), key=words.__getitem__)
        for i, tokens in zip(order, encodings([words[i] for i in order], self.merges), strict=True):
            found[i] = array("i", map(ids, tokens)).tobytes()
        return pa.array(found, pa.large_binary())

    def rows(self, texts: pa.Array) -> tuple[pa.ListArray, pa.StringArray]:
        """For each text its ids and what they decode to."""
        gc.disable()  # nothing here is a cycle
        try:
            found = self.pieces.strung(*cut(pc.fill_null(texts, "")))
        finally:
            gc.enable()
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1) // 4
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, found.buffers()[2] or pa.py_buffer(b"")])
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
        # A text's first token has no space before it.
        spoken = flat.to_numpy().copy()
        spoken[ends[:-1][ends[:-1] < ends[1:]]] += len(self.spoken) // 2
        return ids, joined(self.spoken, ends, spoken).cast(pa.large_string()).cast(pa.string())

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids as little-endian 32-bit numbers, and in UTF-8 what they decode to."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return [], []
        ids, decoded = self.rows(texts)
        return [row.values.to_numpy().tobytes() for row in ids], [text.as_py().encode() for text in decoded]


_loaded: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def _encode(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                ids, decoded = _encoder(tokenizer).rows(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"])
                del ids, decoded
                give_back()

    return lean(run)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text, without an exchange.

    Null texts count as empty: no ids, decoded to the empty text.  Null ids
    stay null, repeated rows are kept, an empty table gives none.  Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(_encode(tokenizer), ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded texts."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
