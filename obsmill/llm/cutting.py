"""Cutting-stock patterns by column generation, for a histogram of lengths.

A pattern says how many pieces of each length share a sequence.  It costs the
tokens that the sequence occupies: the capacity, or its own total where that is
a power of two, as such sequences need no padding.  A linear program decides
how often each pattern is used.  It starts with few patterns; its dual prices
go into a knapsack, whose best fillings are the patterns worth adding.

The work depends on the capacity alone, not on the number of documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Plan(NamedTuple):
    """Rows (pattern, length, copies, offset in the sequence) and the uses of each pattern."""

    rows: np.ndarray
    uses: np.ndarray


def _power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def cost_of(total: int, capacity: int) -> int:
    return total if _power_of_two(total) else capacity


def _fillings(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total, the value of its best filling and the length of that filling's last piece.

    Lengths may repeat.  A total that no pieces reach has the value -inf.
    """
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0.0
    last = np.zeros(capacity + 1, dtype=np.int64)
    for total in range(int(lengths[0]), capacity + 1):
        fit = np.searchsorted(lengths, total, side="right")
        got = value[total - lengths[:fit]] + prices[:fit]
        best = int(got.argmax())
        value[total], last[total] = got[best], lengths[best]
    return value, last


def _pieces(last: np.ndarray, total: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while total:
        length = int(last[total])
        found[length] = found.get(length, 0) + 1
        total -= length
    return found


def _fill(left: np.ndarray, room: int) -> list[int]:
    """Lengths still there that fill the room exactly with one, two or more pieces, or nearly."""
    pieces: list[int] = []
    while room > 0:
        if left[room] > pieces.count(room):
            return [*pieces, room]
        there = left[: room + 1] > 0
        both = np.flatnonzero(there & there[::-1])
        for a in both[both >= room - both][::-1].tolist():
            pair = [*pieces, a, room - a]
            if all(left[x] >= pair.count(x) for x in (a, room - a)):
                return pair
        fit = [x for x in np.flatnonzero(there)[::-1][:50].tolist() if left[x] > pieces.count(x)]
        if not fit:
            break
        pieces.append(fit[0])
        room -= fit[0]
    return pieces


def _first_patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int], int]]:
    """(length, pattern, uses): a pattern for each length, which uses up its last pieces.

    The longest piece left is joined by pieces that fill the sequence, as often
    as there are enough of them.  Each step uses up one length at least, so the
    patterns form a triangular basis.
    """
    left, found = counts.copy(), []
    for longest in np.flatnonzero(counts)[::-1].tolist():
        while left[longest]:
            left[longest] -= 1
            pieces = [longest] if _power_of_two(longest) else [longest, *_fill(left, capacity - longest)]
            left[longest] += 1
            pattern = {a: pieces.count(a) for a in dict.fromkeys(pieces)}
            uses = min(int(left[a]) // n for a, n in pattern.items())
            ended = min(pattern, key=lambda a: (left[a] - uses * pattern[a], -a))
            if left[ended] != uses * pattern[ended]:
                pattern, uses, ended = {longest: 1}, int(left[longest]), longest
            for a, n in pattern.items():
                left[a] -= uses * n
            found.append((ended, pattern, uses))
    done = {length for length, _, _ in found}
    return found + [(a, {a: 1}, 0) for a in np.flatnonzero(counts).tolist() if a not in done]


class _Program:
    """The linear program over the known patterns, kept at a feasible basis.

    It runs in the driver beside Spark, so it does without threaded algebra.

    One equation for each length: the copies in the patterns used add up to the
    number of pieces of that length.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        self.lengths = np.flatnonzero(counts)
        self.row = {int(length): i for i, length in enumerate(self.lengths)}
        size = len(self.lengths)
        self.basis: list[dict[int, int]] = [{}] * size
        self.uses = np.zeros(size)
        self.inverse = np.zeros((size, size))
        first = _first_patterns(counts, capacity)
        holding: dict[int, list[tuple[int, int]]] = {}
        for ended, pattern, uses in first:
            at = self.row[ended]
            self.basis[at], self.uses[at] = pattern, uses
            for length, copies in pattern.items():
                if length != ended:
                    holding.setdefault(length, []).append((at, copies))
        # Only patterns found earlier hold a length that a pattern uses up, so the
        # rows of the inverse follow from one another in that order.
        for ended, pattern, _ in first:
            at = self.row[ended]
            self.inverse[at, at] = 1.0
            for other, copies in holding.get(ended, ()):
                self.inverse[at] -= copies * self.inverse[other]
            self.inverse[at] /= pattern[ended]
        self.costs = np.array([self._cost(pattern) for pattern in self.basis])
        self.total = float(counts @ np.arange(len(counts)))

    def _cost(self, pattern: dict[int, int]) -> float:
        return float(cost_of(sum(a * n for a, n in pattern.items()), self.capacity))

    def prices(self) -> np.ndarray:
        return np.einsum("i,ij->j", self.costs, self.inverse)

    def cost(self) -> float:
        return float(self.costs @ self.uses)

    def enter(self, pattern: dict[int, int]) -> None:
        rows = [self.row[length] for length in pattern]
        step = np.einsum("ij,j->i", self.inverse[:, rows], np.array(list(pattern.values()), dtype=float))
        ratio = np.full(len(step), np.inf)
        np.divide(self.uses, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return
        self.uses = np.maximum(self.uses - ratio[out] * step, 0.0)
        self.uses[out] = ratio[out]
        pivot = self.inverse[out] / step[out]
        self.inverse -= np.outer(step, pivot)
        self.inverse[out] = pivot
        self.basis[out] = pattern
        self.costs[out] = self._cost(pattern)


def plan(counts: np.ndarray, capacity: int, slack: float = 0.001, rounds: int = 40, columns: int = 16) -> Plan:
    """Whole uses of patterns for `counts[length]` pieces of each length below the capacity.

    Stops when no pattern helps, when padding is below `slack` of all tokens,
    when a round saves less than a hundredth of that, or after `rounds`
    knapsacks, of which each adds up to `columns` patterns.  Any stop leaves
    valid patterns.  Uses are rounded, but never beyond the pieces there are.
    Left to the caller, who may cut them, are pieces that no whole use covers
    and those whose pattern leaves more than four times `slack` of its sequence
    empty (a frequent length may have no fitting partners at all).
    """
    program = _Program(counts, capacity)
    if not len(program.lengths):
        return Plan(np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64))
    price_of_total = np.array([cost_of(t, capacity) for t in range(capacity + 1)], dtype=float)
    cost = np.inf
    for _ in range(rounds):
        if program.cost() <= program.total * (1 + slack) or program.cost() > cost - program.total * slack / 100:
            break
        cost = program.cost()
        prices = program.prices()
        value, last = _fillings(prices, program.lengths, capacity)
        gain = value - price_of_total
        gain[0] = -np.inf
        promising = [int(t) for t in np.argsort(-gain)[:columns] if gain[t] > 1e-6]
        if not promising:
            break
        for total in promising:
            pattern = _pieces(last, total)
            worth = sum(n * prices[program.row[a]] for a, n in pattern.items())
            if worth - price_of_total[total] > 1e-6:
                program.enter(pattern)
                prices = program.prices()
    return _rounded(program, counts, 4 * slack)


def _rounded(program: _Program, counts: np.ndarray, waste: float) -> Plan:
    left = counts.astype(np.int64).copy()
    rows, uses = [], []
    for i in np.argsort(-program.uses, kind="stable"):
        pattern = program.basis[i]
        most = min(int(left[a]) // n for a, n in pattern.items())
        times = min(int(np.rint(program.uses[i])), most)
        total = sum(a * n for a, n in pattern.items())
        if times <= 0 or program.costs[i] - total > waste * program.capacity:
            continue
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((len(uses), length, pattern[length], offset))
            offset += length * pattern[length]
            left[length] -= times * pattern[length]
        uses.append(times)
    return Plan(np.array(rows, dtype=np.int64).reshape(-1, 4), np.array(uses, dtype=np.int64))
