"""Content-defined pieces of texts: where a long passage is shared, so are the pieces' keys.

A text is a row of letters: bytes, or hashes of words.  Every window of
`length` letters is given the smallest hash among its runs of `gram` letters as
its key.  Equal windows have equal keys wherever they stand, so
windows of different keys never need to be compared.  Neighbouring windows
mostly share a key; such a run of windows is one piece.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

CHUNK = 1 << 17
_draw = np.random.default_rng(1)
_LETTERS = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(20)
_PLACES = np.uint64((1 << 20) - 1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(int(_BASE), CHUNK + 4096)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), CHUNK + 4096)


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` letters: differences of one running sum, scaled to the same place."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    drawn = _LETTERS[data] if data.dtype == np.uint8 else data * _LETTERS[0] | np.uint64(1)
    np.cumsum(drawn * _UP[: len(data)], out=sums[1:])
    found = (sums[size:] - sums[:-size]) * _DOWN[: len(data) - size + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: of the end of one block and the start of the next."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(blocks, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


class Pieces(NamedTuple):
    """For each piece its key, the first start of its windows, the end of the starts, and whether its key leads windows from two places."""

    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    repeats: np.ndarray


def _chunk(data: np.ndarray, length: int, gram: int, ends: np.ndarray) -> Pieces:
    """The pieces of neighbouring texts that end at `ends`; windows never cross an end."""
    width = length - gram + 1
    found = hashes(data, gram)
    places = np.arange(len(found), dtype=np.uint64)
    first = (_sliding_least(found & ~_PLACES | places, width) & _PLACES).astype(np.int64)
    keys = found[first]
    begins = np.concatenate([[0], ends[:-1]])
    borders = np.concatenate([begins, np.maximum(begins, ends - length + 1)])
    change = np.concatenate([[True], keys[1:] != keys[:-1]])
    change[borders[borders < len(keys)]] = True
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], len(keys))
    whole = starts + length <= ends[np.searchsorted(ends, starts, side="right")]
    starts, stops = starts[whole], stops[whole]
    # Equal windows have their key's run equally far from their start, so windows of one run differ.
    return Pieces(keys[starts], starts, stops, first[starts] != first[stops - 1])


def together(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Pieces:
    """The pieces of texts that stand one after the other and end at `ends`; short texts share their passes over arrays."""
    begins = np.concatenate([[0], ends[:-1]])
    found, at = [], 0
    while at < len(ends):
        begin = int(begins[at])
        after = int(np.searchsorted(ends, begin + CHUNK, side="right"))
        if after <= at:
            own, after = pieces(data[begin : ends[at]], length, gram), at + 1
        elif ends[after - 1] - begin < length:
            own = pieces(data[:0], length, gram)
        else:
            own = _chunk(data[begin : ends[after - 1]], length, gram, ends[at:after] - begin)
        found.append(own._replace(starts=own.starts + begin, ends=own.ends + begin))
        at = after
    return Pieces(*(np.concatenate(c) for c in zip(*found, strict=True)))


def pieces(data: np.ndarray, length: int, gram: int) -> Pieces:
    """The pieces of one text; none if it is shorter than a window.  Long texts are taken in chunks."""
    if len(data) < length:
        empty = np.zeros(0, dtype=np.int64)
        return Pieces(empty.astype(np.uint64), empty, empty, empty.astype(bool))
    found = []
    for at in range(0, len(data) - length + 1, CHUNK):
        chunk = data[at : at + CHUNK + length - 1]
        own = _chunk(chunk, length, gram, np.array([len(chunk)]))
        found.append(own._replace(starts=own.starts + at, ends=own.ends + at))
    return Pieces(*(np.concatenate(c) for c in zip(*found, strict=True)))


def narrowed(data: np.ndarray, key: int, start: int, end: int, length: int, gram: int, step: int) -> list[tuple[int, int, int, int, int]]:
    """(first, end, class, core begin, core end): the parts of a piece by how far in their windows the key's run begins.

    Windows of one class of `step` places all hold the part's core, which the
    place of the run alone decides; so equal windows are in parts of the same
    class with equal cores.
    """
    own = data[start : end + length - 1]
    places = np.flatnonzero(hashes(own, gram) == np.uint64(key))
    starts = np.arange(end - start)
    first = places[np.searchsorted(places, starts)]
    classes = (first - starts) // step
    cuts = np.flatnonzero(np.diff(first) | np.diff(classes)) + 1
    parts = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), end - start], strict=True):
        kind, place = int(classes[a]), start + int(first[a])
        last = min(kind * step + step - 1, length - gram)  # the farthest place of the class in a window
        parts.append((start + a, start + b, kind, place - kind * step, place - last + length))
    return parts
