"""Cuts texts at spaces, tells equal pieces by numbers and remembers their ids, without an object for every piece."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Remembered(NamedTuple):
    """Distinct pieces, the ids of each, and the call that used each last; rows of Arrow, without an object for each."""

    pieces: pa.Array
    ids: pa.Array
    used: np.ndarray

    @classmethod
    def nothing(cls) -> Remembered:
        return cls(pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64))

    def only(self, most: int, long: int) -> Remembered:
        """Pieces of up to `long` bytes; if these are too many, the half of the most that was used last."""
        kept = np.flatnonzero(pc.binary_length(self.pieces).to_numpy() <= long)
        if len(kept) > most:
            last = np.argsort(-self.used[kept], kind="stable")[: most // 2]
            kept = kept[np.sort(last)]
        if len(kept) == len(self.used):
            return self
        return Remembered(self.pieces.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.used[kept])


class Known:
    """The ids of up to `most` pieces of up to `long` bytes, from one call to the next; `learn` gives those of new ones."""

    def __init__(self, most: int, long: int, learn: Callable[[list[str]], pa.Array]):
        self.most, self.long, self.learn, self.rows, self.calls = most, long, learn, Remembered.nothing(), 0

    @property
    def young(self) -> list[str]:
        """The pieces that are remembered."""
        return self.rows.pieces.to_pylist()

    def strung(self, pieces: pa.Array, begins: np.ndarray) -> pa.Array:
        """The ids of each run of pieces in a row; a run begins where `begins` tells."""
        if not len(pieces):
            return pa.array([b""] * (len(begins) - 1), pa.large_binary())
        # The numbers of known pieces come first, in their order, and those of new ones after them.
        coded = pa.chunked_array([self.rows.pieces, pieces]).dictionary_encode()
        last = coded.chunk(coded.num_chunks - 1)
        entries, distinct = last.indices.to_numpy(), last.dictionary
        new = self.learn(distinct.slice(len(self.rows.pieces)).to_pylist())
        self.calls += 1
        used = np.concatenate([self.rows.used, np.zeros(len(new), dtype=np.int64)])
        used[entries] = self.calls
        ids = pa.concat_arrays([self.rows.ids, new])
        self.rows = Remembered(distinct, ids, used).only(self.most, self.long)
        return joined(ids, begins, entries)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts between spaces, of which a text of n spaces has n + 1; where each text's begin, and the end."""
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    begins = split.offsets.to_numpy()
    return split.flatten(), begins - begins[0]


def joined(values: pa.Array, begins: np.ndarray, entries: np.ndarray) -> pa.Array:
    """For each run of entries their values in a row, as rows of Arrow; a run begins where `begins` tells."""
    if not len(entries):
        return pa.array([b""] * (len(begins) - 1), pa.large_binary())
    taken = values.take(pa.array(entries))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[begins]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(ends), taken.buffers()[2]])


def strung(values: Sequence[bytes] | pa.LargeBinaryArray, begins: np.ndarray, entries: np.ndarray) -> list[bytes]:
    """For each text the values of its pieces in a row; its pieces begin where `begins` tells."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())
    taken = values.take(pa.array(entries))
    raw = pa.py_buffer(taken.buffers()[2]) if taken.buffers()[2] else b""
    view = memoryview(raw)
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[begins].tolist()
    return [bytes(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
