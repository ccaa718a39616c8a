"""Byte-level BPE with the tokenizers library, one call per distinct piece of text."""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from obsmill.llm.pieces import Remembered, strung

# A run of Latin letters, with the space before it: one word of the byte-level pattern.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER, _OTHER, _SIGN, _WHITE = (np.zeros(256, dtype=bool) for _ in range(4))
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_OTHER[:128] = ~_LETTER[:128]
# What is no letter, space or apostrophe, which may begin a contraction.
_SIGN[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_SIGN[0x27] = False
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
# First bytes of white space beyond ASCII.
_WIDE = np.zeros(256, dtype=bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Longer pieces are not remembered, so what is remembered is bounded in bytes.
LONG = 64


def begins(data: np.ndarray, ends: np.ndarray, words: bool) -> np.ndarray:
    """Where a text can be cut without changing its tokens: the places of UTF-8 bytes that begin a piece.

    `ends` are the ends of the texts, which always begin a piece too.  A space
    before something else than white space always starts a new word of the
    byte-level pattern.  With `words`, cuts are made besides where the pattern
    has a border whatever stands around: after a Latin letter before an ASCII
    character that is none, and before an ASCII letter after an ASCII sign or
    after a line break that follows no white space.
    """
    found = data == 0x20
    # A text's last space may belong to white space before it, which is one word.
    found[ends[ends > 0] - 1] = False
    found[:-1] &= ~_WHITE[data[1:]]
    spaces = np.flatnonzero(found[:-1] & _WIDE[data[1:]])
    for at in spaces.tolist():
        found[at] = not bytes(data[at + 1 : at + 4]).decode(errors="ignore")[:1].isspace()
    if words:
        letter = _LETTER[data]
        wide = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        found[1:] |= (letter[:-1] | np.concatenate([[False], wide])[:-1]) & _OTHER[data[1:]]
        found[1:] |= _SIGN[data[:-1]] & letter[1:]
        found[2:] |= (data[:-2] > 0x20) & (data[:-2] < 0x7F) & (data[1:-1] == 0x0A) & letter[2:]
    found[0] = True
    found[ends[ends < len(data)]] = True
    return np.flatnonzero(found)


class PieceEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    Texts are cut where the byte-level pattern always has a border; the library
    sees each distinct piece once, and the ids of up to `most_pieces` short ones
    are kept, so memory is bounded.  Texts that hold an added token are encoded
    in one go, as such tokens may swallow white space.
    """

    def __init__(self, path: str, most_pieces: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = self.tokenizer.get_vocab()  # a token has one letter for each of its bytes
        self.sizes = np.zeros(max(letters.values()) + 1, dtype=np.int64)
        self.sizes[list(letters.values())] = [len(t) for t in letters]
        self.most, self.known, self.calls = most_pieces, Remembered.nothing(), 0
        # Runs of Latin letters, after a space or not, are single words of the pattern, which the model takes as the
        # letters of their bytes; that spares the library's way from texts to words.
        sample, spelled = " Éaÿ", "ĠÃīaÃ¿"
        whole = self.tokenizer.normalizer is None and [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(sample)] == [spelled]
        self.model = self.tokenizer.model if whole else None
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        wide = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        self.spelled = {ord(c): plain.pre_tokenize_str(c)[0][0] for c in [" ", *wide]}

    def _library(self, pieces: list[str], at_once: int = 2_000) -> Iterator[bytes]:
        """The ids of each piece; many pieces share a call, as its overhead exceeds their work.

        Tokens are whole bytes of their piece, so counting them tells where a piece ends.
        """
        groups = [pieces[i : i + at_once] for i in range(0, len(pieces), at_once)]
        encoded = self.tokenizer.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        for group, found in zip(groups, encoded, strict=True):
            ids = np.array(found.ids, dtype="<u4")
            raw, done = ids.tobytes(), np.cumsum(self.sizes[ids])
            ends = (4 * np.searchsorted(done, np.cumsum([len(p.encode()) for p in group]), side="right")).tolist()
            yield from (raw[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def _learned(self, pieces: list[str]) -> pa.Array:
        """The ids of pieces, words of Latin letters by the model alone."""
        if self.model is None:
            return pa.array(self._library(pieces), pa.large_binary())
        tokenize, spelled, is_word = self.model.tokenize, self.spelled, _WORD.fullmatch
        found: list[bytes | None] = [None] * len(pieces)
        others = []
        for i, piece in enumerate(pieces):
            if not is_word(piece):
                others.append(i)
                continue
            if not piece.isascii():
                piece = piece.translate(spelled)
            elif piece[0] == " ":
                piece = "Ġ" + piece[1:]
            found[i] = array("I", [t.id for t in tokenize(piece)]).tobytes()
        for i, ids in zip(others, self._library([pieces[i] for i in others]), strict=True):
            found[i] = ids
        return pa.array(found, pa.large_binary())

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """One string of ids for each text; null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
        if offsets[-1] == offsets[0]:
            return [b""] * len(texts)
        gc.disable()  # the lists of pieces hold no cycles, and walking them takes time
        try:
            out = self._encode(texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0])
        finally:
            gc.enable()
        special = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            ids = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            out[i] = np.array(ids, dtype="<u4").tobytes()
        return out

    def _encode(self, raw: pa.Buffer, offsets: np.ndarray) -> list[bytes]:
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = begins(data, offsets, self.model is not None)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        pieces = pa.LargeStringArray.from_buffers(len(starts), bounds, raw)
        # The numbers of known pieces come first, in their order, and those of new ones after them.
        coded = pa.chunked_array([self.known.pieces, pieces]).dictionary_encode()
        entries, distinct = coded.chunk(coded.num_chunks - 1).indices.to_numpy(), coded.chunk(coded.num_chunks - 1).dictionary
        new = self._learned(distinct.slice(len(self.known.pieces)).to_pylist())
        self.calls += 1
        used = np.concatenate([self.known.used, np.zeros(len(new), dtype=np.int64)])
        used[entries] = self.calls
        ids = pa.concat_arrays([self.known.ids, new])
        self.known = Remembered(distinct, ids, used).only(self.most, LONG)
        return strung(ids, np.searchsorted(starts, offsets), entries)


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file; it outlives a task, and so do the pieces it knows."""
    if path not in _loaded:
        # Spark's tasks fill the cores; threads of the library would only add to them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]
