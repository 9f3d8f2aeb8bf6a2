"""Sorted words of one length as a grid of (forward rank, reverse rank), reported by rectangles.

Everything here is vectorised over many queries of one task; the size of a grid is
bounded by the block of words that its caller holds.
"""

from __future__ import annotations

import numpy as np


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points, a row per word of ``length``."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def intervals(grid: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), a row per depth: the rows of the sorted ``grid`` that begin with that many letters of each asked word."""
    n, depth = len(asked), min(asked.shape[1], grid.shape[1])
    low, high = np.zeros((depth + 1, n), np.int64), np.empty((depth + 1, n), np.int64)
    high[0] = len(grid)
    steps = int(len(grid)).bit_length()
    for i in range(depth):
        column, c = np.append(grid[:, i], 0), asked[:, i]
        for out, above in ((low, False), (high, True)):
            a, b = low[i].copy(), high[i].copy()
            for _ in range(steps):
                mid = (a + b) >> 1
                open_ = a < b
                right = open_ & ((column[mid] <= c) if above else (column[mid] < c))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            out[i + 1] = a
    return low, high


class Wavelet:
    """A permutation as a wavelet tree, levels from the highest bit down."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        at = values
        for k in range(self.bits - 1, -1, -1):
            one = (at >> k) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            at = np.concatenate([at[one == 0], at[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values from ``low`` to before ``high`` at places from ``left`` to before ``right``."""
        q = np.flatnonzero((left < right) & (low < high))
        l, r, v = left[q], right[q], np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            rest = self.bits - 1 - level
            l0, r0, none = zeros[l], zeros[r], zeros[-1]
            q, l, r = np.concatenate([q, q]), np.concatenate([l0, none + l - l0]), np.concatenate([r0, none + r - r0])
            v = np.concatenate([v << 1, (v << 1) | 1])
            ok = (l < r) & ((v << rest) < high[q]) & (((v + 1) << rest) > low[q])
            q, l, r, v = q[ok], l[ok], r[ok], v[ok]
        return q, v


class Grid:
    """The words of one length in a block, in forward order, with the reverse rank of each."""

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        self.words = np.array(words, object)
        self.grid = letters(words, self.length)
        back = self.grid[:, ::-1]
        self.by_end = np.lexsort(back.T[::-1]) if self.length else np.arange(len(words))
        self.back = back[self.by_end]
        rank = np.empty(len(words), np.int64)
        rank[self.by_end] = np.arange(len(words))
        self.tree = Wavelet(rank)

    def near(self, asked: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked row, place of the edit, word of the grid), the edit at a place from ``first`` to before ``last``.

        Asked words are as long as the grid's (one letter replaced) or one shorter (one
        inserted). A word of the grid that an insertion reaches at several places is given
        at each.
        """
        length = asked.shape[1]
        after = 1 if length == self.length else 0
        low, high = intervals(self.grid, asked)
        r_low, r_high = intervals(self.back, asked[:, ::-1])
        n = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(asked)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        rest = length - at - after
        l, r, a, b = low[at, row], high[at, row], r_low[rest, row], r_high[rest, row]
        itself = (high[length] > low[length]).astype(np.int64)[row] * after  # an asked word that the grid holds is in all its intervals
        some = (r - l > itself) & (b - a > itself)
        row, at = row[some], at[some]
        q, v = self.tree.report(l[some], r[some], a[some], b[some])
        row, at, found = row[q], at[q], self.by_end[v]
        if after:
            other = self.grid[found, at] != asked[row, at]
            return row[other], at[other], found[other]
        return row, at, found
