"""How many sequences of which documents: pattern packing on a histogram of lengths.

Lengths are counted in steps of capacity / ``STEPS``, rounded up. A pattern is one to
``MOST_IN_PATTERN`` lengths that fill a sequence to the last step. How often each pattern is
used is fitted to the histogram by non-negative least squares, longer documents weighing
more, and rounded; no pattern takes documents that are not there. A pattern's last document is the
longest that still fits, by its true length. What is left goes into the fullest sequence it
still fits, longest first.

All of it works on counts of lengths: time and memory depend on the capacity, not on the
number of documents. Sequences that hold the same lengths are a range of numbers, so a plan has
a line for each run of documents of one length, not for each document.
"""

from __future__ import annotations

import bisect
import numpy as np

STEPS = 256
MOST_IN_PATTERN = 3
#: Columns of a plan: documents ``k`` of a length from ``start`` on are dealt over ``n`` sequences
#: from ``sequence`` on, round and round, each behind the one before from ``offset`` on.
COLUMNS = ("length", "start", "sequence", "n", "offset")


def enumerate_patterns(whole: int, parts: list[int], most: int = MOST_IN_PATTERN) -> list[tuple[int, ...]]:
    """All falling tuples of at most ``most`` of the ``parts`` whose sum is ``whole``."""
    known, out = sorted(set(parts), reverse=True), []

    def extend(so_far: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(so_far)
        elif len(so_far) == most - 1:
            if rest in there and rest <= so_far[-1]:
                out.append((*so_far, rest))
        else:
            for p in known:
                if p <= rest and (not so_far or p <= so_far[-1]):
                    extend((*so_far, p), rest - p)

    there = set(known)
    if most == 1:
        return [(whole,)] if whole in there else []
    extend((), whole)
    return out


def least_squares(part: np.ndarray, goal: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(part.T @ part, part.T @ goal)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(part, goal, rcond=None)[0]


def nnls(matrix: np.ndarray, goal: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |matrix x - goal|, by active sets: columns enter by the steepest gradient, one at a time."""
    many = matrix.shape[1]
    x, inside = np.zeros(many), np.zeros(many, bool)
    small = 1e-9 * max(1.0, float(np.abs(matrix.T @ goal).max(initial=0)))
    for _ in range(3 * many if rounds is None else rounds):
        slope = matrix.T @ (goal - matrix @ x)
        slope[inside] = -np.inf
        best = int(np.argmax(slope)) if many else 0
        if not many or slope[best] <= small:
            break
        inside[best] = True
        while True:
            at = np.flatnonzero(inside)
            part = matrix[:, at]
            tried = least_squares(part, goal)
            if tried.min() > 0:
                x[:] = 0
                x[at] = tried
                break
            low = tried <= 0
            now = x[at]
            step = float(np.min(now[low] / np.maximum(now[low] - tried[low], 1e-300)))
            x[at] = now + step * (tried - now)
            x[at[low & (x[at] <= 1e-12 * max(1.0, float(goal.max(initial=0))))]] = 0
            if step == 0:
                x[at[low & (now == 0)]] = 0
            inside &= x > 0
            if not inside.any():
                return x
    return x


class Plan:
    """Runs of documents and the sequences they go to."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.there = np.flatnonzero(counts).tolist()
        self.taken = np.zeros(capacity + 1, np.int64)
        self.lines: list[tuple[int, ...]] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.open: list[int] = []

    def put(self, length: int, each: int, sequence: int, n: int, offset: int) -> None:
        """``each`` documents of a length into each of ``n`` sequences."""
        self.lines.append((length, int(self.taken[length]), sequence, n, offset))
        self.taken[length] += n * each
        self.left[length] -= n * each
        if not self.left[length]:
            del self.there[bisect.bisect_left(self.there, length)]

    def leave(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.open, gap)
            self.gaps[gap].append((sequence, n))

    def take(self, gap: int) -> tuple[int, int]:
        run = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap]
            self.open.remove(gap)
        return run

    def repeat(self, tops: list[int], times: int) -> None:
        """``times`` sequences of one document for each of ``tops``, the longest up to it; the last one up to the gap."""
        runs = [(self.sequences, times, 0)]
        self.sequences += times
        for k, top in enumerate(tops):
            after = []
            for sequence, n, used in runs:
                while n:
                    at = bisect.bisect_right(self.there, self.capacity - used if k == len(tops) - 1 else top) - 1
                    if at < 0:
                        after.append((sequence, n, used))
                        break
                    length = self.there[at]
                    some = int(min(n, self.left[length]))
                    self.put(length, 1, sequence, some, used)
                    after.append((sequence, some, used + length))
                    sequence, n = sequence + some, n - some
            runs = after
        for sequence, n, used in runs:
            self.leave(self.capacity - used, sequence, n)

    def best_fit(self) -> None:
        """All that is left, longest first, each into the smallest gap it fits."""
        while self.there:
            length = self.there[-1]
            while (c := int(self.left[length])) > 0:
                at = bisect.bisect_left(self.open, length)
                if at < len(self.open):
                    gap = self.open[at]
                    sequence, n = self.take(gap)
                else:
                    gap, sequence, n = self.capacity, self.sequences, -(-c // (self.capacity // length))
                    self.sequences += n
                each = gap // length
                full = min(n, c // each)
                if full:
                    self.put(length, each, sequence, full, self.capacity - gap)
                    self.leave(gap - each * length, sequence, full)
                if full < n and (rest := int(min(self.left[length], each - 1))):
                    self.put(length, rest, sequence + full, 1, self.capacity - gap)
                    self.leave(gap - rest * length, sequence + full, 1)
                    full += 1
                self.leave(gap, sequence + full, n - full)


def plan(counts: np.ndarray, capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """The lines of the plan for ``counts[length]`` documents, by length and start, and the number of sequences."""
    steps = min(STEPS, capacity)
    out = Plan(counts, capacity)
    lengths = np.flatnonzero(counts)
    of = -(-lengths * steps // capacity)
    binned = np.bincount(of, weights=counts[lengths], minlength=steps + 1)
    patterns = enumerate_patterns(steps, np.flatnonzero(binned).tolist())
    if patterns:
        matrix = np.zeros((steps + 1, len(patterns)))
        for k, pattern in enumerate(patterns):
            np.add.at(matrix[:, k], list(pattern), 1)
        weight = np.arange(steps + 1) / steps
        times = np.floor(nnls(matrix * weight[:, None], binned * weight) + 0.5).astype(np.int64)
        there = binned.astype(np.int64)
        for k in np.argsort(-times, kind="stable"):
            need = matrix[:, k].astype(np.int64)
            some = int(min(times[k], (there[need > 0] // need[need > 0]).min()))
            if some > 0:
                there -= some * need
                out.repeat([b * capacity // steps for b in patterns[k]], some)
    out.best_fit()
    lines = np.array(sorted(out.lines), np.int64).reshape(-1, len(COLUMNS))
    return {c: lines[:, i] for i, c in enumerate(COLUMNS)}, out.sequences
