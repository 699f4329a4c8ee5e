"""Sparse matrices in compressed rows, made by hand, and their products row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Products of single entries that are held at once.
ENTRIES = 1 << 22


@dataclass
class Rows:
    """Row r holds the columns ``columns[starts[r] : starts[r + 1]]`` with their ``values``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transpose(self) -> Rows:
        """The same entries by columns: a count for each, then each entry to its place."""
        starts = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))]
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(self.height), np.diff(self.starts))
        return Rows(starts, row[order], self.values[order], self.height)


def incidence(starts: np.ndarray, columns: np.ndarray, width: int) -> Rows:
    return Rows(starts, columns, np.ones(len(columns), np.int64), width)


def reach(a: Rows, b: Rows) -> np.ndarray:
    """For each row of ``a`` how many products of entries its row of a·b adds up (the symbolic pass)."""
    each = np.r_[0, np.cumsum(np.diff(b.starts)[a.columns])]
    return each[a.starts[1:]] - each[a.starts[:-1]]


def product(a: Rows, b: Rows) -> Rows:
    """a·b by Gustavson's rule: row i adds up the rows k of b that row i of a names, times its values.

    Runs of rows with about ``ENTRIES`` products are worked on at once, a larger row alone.
    """
    sizes = reach(a, b)
    ends = np.cumsum(sizes)
    counts, columns, values, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < a.height:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, side="right")))
        own = slice(a.starts[at], a.starts[to])
        k = a.columns[own]
        width = b.starts[k + 1] - b.starts[k]
        last = np.cumsum(width)
        place = np.repeat(b.starts[k] - (last - width), width) + np.arange(last[-1] if len(last) else 0)
        row = np.repeat(np.arange(to - at), sizes[at:to])
        key = row * b.width + b.columns[place]
        value = np.repeat(a.values[own], width) * b.values[place]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        values.append(np.add.reduceat(value, first) if len(first) else value)
        columns.append(key[first] % b.width if len(first) else key)
        counts.append(np.bincount(key[first] // b.width, minlength=to - at) if len(first) else np.zeros(to - at, np.int64))
        at = to
    return Rows(np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(columns), np.concatenate(values), b.width)
