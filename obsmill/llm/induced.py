"""Suffix arrays with common-prefix values by induced sorting, over disk-backed queues.

Suffixes are of type S if they are smaller than the one after them, else L.
The order of the leftmost S suffixes (the seeds) fixes the order of all: going
through the suffixes in ascending order, the L suffix before each is the next
of its first letter; in descending order, the same holds for S.  What is still
to come waits in a priority queue with its common prefix, one more than the
least on the way between the two suffixes that it follows from.

Seeds are sorted by sorting the stretches between them in the same way, naming
them by rank and sorting the string of names: again by induction while names
are few, else by doubling.  Only the first `depth` letters count; beyond them
the order is open.  Queues hold whole runs of tuples, so the work is done in
numpy; beyond a size they wait in a temporary file of the task.
"""

from __future__ import annotations

import tempfile
from typing import NamedTuple

import numpy as np

#: Strings with more distinct letters than this are sorted by doubling.
MOST_LETTERS = 4096


class Run(NamedTuple):
    """Suffixes in order, and for each the common prefix with the one before it."""

    places: np.ndarray
    common: np.ndarray

    @classmethod
    def joined(cls, runs: list[Run]) -> Run:
        if not runs:
            return cls(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint16))
        return runs[0] if len(runs) == 1 else cls(*(np.concatenate(c) for c in zip(*runs, strict=True)))


class SuffixQueue:
    """A priority queue of runs by first letter, first in first out; letters leave in order.

    Once the waiting tuples exceed `memory` bytes, they go to a temporary file,
    from which they come back when their letter's turn is there.
    """

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.waiting: dict[int, list[Run | tuple[int, int]]] = {}
        self.file = None

    def push(self, letter: int, run: Run) -> None:
        self.waiting.setdefault(letter, []).append(run)
        self.held += run.places.nbytes + run.common.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for letter, runs in self.waiting.items():
            for i, run in enumerate(runs):
                if isinstance(run, Run):
                    runs[i] = (self.file.tell(), len(run.places))
                    self.file.write(run.places.tobytes())
                    self.file.write(run.common.tobytes())
            self.waiting[letter] = runs
        self.held = 0

    def _read(self, at: int, count: int) -> Run:
        self.file.seek(at)
        places = np.frombuffer(self.file.read(4 * count), dtype=np.int32)
        return Run(places, np.frombuffer(self.file.read(2 * count), dtype=np.uint16))

    def pop(self, letter: int) -> Run:
        """All that waits for a letter, in the order it came."""
        runs = self.waiting.pop(letter, [])
        self.held -= sum(r.places.nbytes + r.common.nbytes for r in runs if isinstance(r, Run))
        return Run.joined([r if isinstance(r, Run) else self._read(*r) for r in runs])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Text:
    """A string of letters that ends in a unique smallest one, with the types of its suffixes."""

    def __init__(self, letters: np.ndarray, depth: int, memory: int):
        self.letters, self.depth, self.memory = letters, depth, memory
        size = len(letters)
        changes = np.flatnonzero(letters[1:] != letters[:-1])
        # The place after each run of one letter decides the type of the whole run.
        lengths = np.diff(changes, prepend=-1)
        rises = letters[changes + 1] > letters[changes]
        self.small = np.empty(size, dtype=bool)
        self.small[:-1] = np.repeat(rises, lengths)
        self.small[-1] = True
        ends = np.repeat((changes + 1).astype(np.int32), lengths)
        self.same = np.ones(size, dtype=np.uint16)  # letters from here that are the same, up to the depth
        self.same[:-1] = np.minimum(ends - np.arange(size - 1, dtype=np.int32), depth)
        self.seeds = (np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1).astype(np.int32)
        self.sigma = int(letters.max()) + 1

    def between(self, a: int, b: int) -> int:
        """The common prefix of an L and an S suffix of the same first letter."""
        return min(int(self.same[a]), int(self.same[b]))


def _least_between(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of values[begin:end] for stretches that are not empty."""
    bounds = np.empty(2 * len(begins), dtype=np.int64)
    bounds[::2], bounds[1::2] = begins, ends
    return np.minimum.reduceat(np.append(values, values[-1:]), bounds)[::2]


class _Pass:
    """One sweep over the suffixes, up or down, that induces those of one type."""

    def __init__(self, text: _Text, small: bool, with_common: bool):
        self.text, self.small, self.with_common = text, small, with_common
        self.queue = SuffixQueue(text.memory)
        self.least = np.zeros(text.sigma, dtype=np.uint16)  # since the last suffix of each letter

    def visit(self, run: Run) -> None:
        """Queues the suffixes before these that are of the type, each with its common prefix."""
        text, places = self.text, run.places
        before = places - 1
        fits = (places > 0) & (text.small[before] == self.small)
        index = np.flatnonzero(fits)
        before = before[index]
        letters = text.letters[before]
        order = np.argsort(letters, kind="stable")
        before, letters, index = before[order], letters[order], index[order]
        starts = np.flatnonzero(np.diff(letters, prepend=-1)) if len(letters) else np.zeros(0, dtype=np.int64)
        if self.with_common:
            common = self._common(run.common, letters, index, starts)
        else:
            common = np.zeros(len(before), dtype=np.uint16)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(before)], strict=False):
            self.queue.push(int(letters[a]), Run(before[a:b], common[a:b]))

    def _common(self, on_way: np.ndarray, letters: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(letters):
            if len(on_way):
                np.minimum(self.least, on_way.min(), out=self.least)
            return np.zeros(0, dtype=np.uint16)
        begins = np.empty(len(index), dtype=np.int64)
        begins[1:] = index[:-1] + 1
        begins[starts] = 0
        common = _least_between(on_way, begins, index + 1)
        first = letters[starts]
        common[starts] = np.minimum(common[starts], self.least[first])
        lasts = index[np.append(starts[1:], len(index)) - 1] + 1
        np.minimum(self.least, on_way.min(), out=self.least)
        ending = np.full(len(lasts), self.text.depth, dtype=np.uint16)
        open_ = lasts < len(on_way)
        if open_.any():
            backward = np.minimum.accumulate(on_way[::-1])[::-1]
            ending[open_] = backward[lasts[open_]]
        self.least[first] = ending
        return np.minimum(common + np.uint16(1), np.uint16(self.text.depth))


def _induce(text: _Text, seeds: Run, with_common: bool) -> tuple[list[Run], list[Run]]:
    """For each letter its L suffixes in ascending order and its S suffixes in descending order."""
    by_letter = text.letters[seeds.places]
    bounds = np.searchsorted(by_letter, np.arange(text.sigma + 1)).tolist()
    nothing = Run.joined([])
    large, small = [nothing] * text.sigma, [nothing] * text.sigma
    up = _Pass(text, False, with_common)
    for letter in range(text.sigma):
        waves = []
        while len((wave := up.queue.pop(letter)).places):
            if with_common and not waves:
                wave.common.flags.writeable or (wave := Run(wave.places, wave.common.copy()))
                wave.common[0] = 0
            waves.append(wave)
            up.visit(wave)
        large[letter] = Run.joined(waves)
        own = Run(seeds.places[bounds[letter] : bounds[letter + 1]], seeds.common[bounds[letter] : bounds[letter + 1]].copy())
        if len(own.places):
            if with_common:
                own.common[0] = text.between(large[letter].places[-1], own.places[0]) if waves else 0
            up.visit(own)
    up.queue.close()
    down = _Pass(text, True, with_common)
    for letter in reversed(range(text.sigma)):
        waves = []
        while len((wave := down.queue.pop(letter)).places):
            if with_common and not waves:
                wave.common.flags.writeable or (wave := Run(wave.places, wave.common.copy()))
                wave.common[0] = 0
            waves.append(wave)
            down.visit(wave)
        small[letter] = Run.joined(waves)
        ascending = large[letter]
        if len(ascending.places):
            common = np.zeros(len(ascending.places), dtype=np.uint16)
            if with_common:
                common[1:] = ascending.common[:0:-1]
                common[0] = text.between(ascending.places[-1], small[letter].places[-1]) if waves else 0
            down.visit(Run(ascending.places[::-1], common))
    down.queue.close()
    return large, small


def _seed_order(text: _Text) -> np.ndarray:
    """The seeds in the order of their suffixes, up to the depth."""
    seeds, size = text.seeds, len(text.letters)
    if len(seeds) < 2:
        return seeds
    rough = seeds[np.argsort(text.letters[seeds], kind="stable")]
    _, small = _induce(text, Run(rough, np.zeros(len(rough), dtype=np.uint16)), False)
    is_seed = np.zeros(size, dtype=bool)
    is_seed[seeds] = True
    ordered = np.concatenate([run.places[::-1] for run in small])
    # The last letter has no suffix before it that would bring it in.
    ordered = ordered[is_seed[ordered]]
    ordered = np.concatenate([seeds[-1:], ordered[ordered != seeds[-1]]])
    number = np.empty(size, dtype=np.int32)
    number[seeds] = np.arange(len(seeds), dtype=np.int32)
    stops = np.append(seeds[1:], size - 1)
    lengths = stops - seeds + 1
    at = number[ordered]
    same = lengths[at[1:]] == lengths[at[:-1]]
    pair = np.flatnonzero(same)
    a, b, left = ordered[:-1][pair], ordered[1:][pair], lengths[at[1:]][pair]
    step = 0
    while len(pair):
        equal = text.letters[a + step] == text.letters[b + step]
        same[pair[~equal]] = False
        step += 1
        keep = equal & (left > step)
        pair, a, b, left = pair[keep], a[keep], b[keep], left[keep]
    names = np.empty(len(seeds), dtype=np.int32)
    names[at] = np.concatenate([[0], np.cumsum(~same)])
    if int(names.max()) + 1 == len(seeds):
        return ordered
    if int(names.max()) < MOST_LETTERS:
        return seeds[suffixes(names, text.depth, text.memory, ends=True).places]
    return seeds[_doubled(names, text.depth)]


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string by ranks of twice as many letters each time."""
    size = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    active = _shared(rank[order])
    while width < depth and active.any():
        slots = np.flatnonzero(active)
        own = order[slots]
        after = own + width
        second = np.where(after < size, rank[np.minimum(after, size - 1)] + 1, 0)
        key = rank[own] * (size + 1) + second
        sorted_ = np.argsort(key, kind="stable")
        order[slots], key = own[sorted_], key[sorted_]
        # A rank is the first slot of its group, so groups keep their place when they part.
        new = np.concatenate([[True], key[1:] != key[:-1]])
        ranks = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = ranks
        if width == 1:
            single = np.flatnonzero(~active)
            rank[order[single]] = single
        active[slots] = _shared(key)
        width *= 2
    return order


def _shared(values: np.ndarray) -> np.ndarray:
    """Which of sorted values have an equal neighbour."""
    equal = values[1:] == values[:-1]
    return np.concatenate([[False], equal]) | np.concatenate([equal, [False]])


def _packed(letters: np.ndarray) -> tuple[np.ndarray, int, int]:
    """From each place as many letters as one word holds, the first lowest; how many, and their bits."""
    bits = max(1, int(letters.max()).bit_length())
    count = 64 // bits
    padded = np.concatenate([letters, np.zeros(count, dtype=letters.dtype)]).astype(np.uint64)
    words = np.zeros(len(letters), dtype=np.uint64)
    for i in range(count):
        words |= padded[i : len(letters) + i] << np.uint64(bits * i)
    return words, count, bits


def _seed_common(text: _Text, ordered: np.ndarray) -> np.ndarray:
    """The common prefix of neighbouring seeds, up to the depth.

    Words are compared up to the end of the string, whose last letter is
    unique, so two suffixes differ there at the latest.
    """
    common = np.zeros(len(ordered), dtype=np.uint16)
    words, count, bits = _packed(text.letters)
    size = len(words)
    pair = np.arange(1, len(ordered))
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    for step in range(0, text.depth, count):
        differ = words[np.minimum(a + step, size - 1)] ^ words[np.minimum(b + step, size - 1)]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ != 0, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // bits, count)
        common[pair] = np.minimum(step + same, text.depth)
        equal = differ == 0
        pair, a, b = pair[equal], a[equal], b[equal]
        if not len(pair):
            break
    return common


def suffixes(letters: np.ndarray, depth: int, memory: int = 64 << 20, ends: bool = False) -> Run:
    """All suffixes of a string in order of their first `depth` letters, with their common prefixes.

    The string's last letter must be its only smallest one; with `ends` that
    isn't so and an end is added, which the result leaves out.
    """
    if ends:
        letters = np.append(letters + 1, 0).astype(letters.dtype)
    if len(letters) == 1:
        return Run(np.zeros(0 if ends else 1, dtype=np.int32), np.zeros(0 if ends else 1, dtype=np.uint16))
    text = _Text(letters, depth, memory)
    ordered = _seed_order(text)
    large, small = _induce(text, Run(ordered, _seed_common(text, ordered)), True)
    last = len(letters) - 1
    runs = [] if ends else [Run(np.array([last], dtype=np.int32), np.zeros(1, dtype=np.uint16))]
    for up, down in zip(large, small, strict=True):
        if len(up.places):
            runs.append(up)
        if len(down.places):
            common = np.empty(len(down.places), dtype=np.uint16)
            common[1:] = down.common[:0:-1]
            common[0] = text.between(up.places[-1], down.places[-1]) if len(up.places) else 0
            runs.append(Run(down.places[::-1], common))
    return Run.joined(runs)
