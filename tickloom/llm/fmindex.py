"""An FM-index over a sequence of small integers, in NumPy: wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling until all ranks differ."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        if n < 2 or new[-1] == n - 1 or step >= n:
            return order
        rank[order] = new
        step *= 2


class FMIndex:
    """Symbols are 1..; 0 separates runs. The text begins and ends with 0, and no phrase holds a 0.

    Besides every SAMPLE-th position the first of each run is sampled, so that a walk never crosses a 0.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        before = text[order - 1]
        self.n, top = len(text), int(text.max()) + 1
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.bits = range(max(1, int(top - 1).bit_length()) - 1, -1, -1)
        self.ones: list[np.ndarray] = []
        level = before.astype(np.int32)
        for bit in self.bits:
            b = (level >> bit) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            level = np.concatenate([level[b == 0], level[b == 1]])
        symbols = np.arange(top)
        self.start = self._follow(symbols, np.zeros(top, np.int64))
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def _follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ones in zip(self.bits, self.ones, strict=True):
            one = ones[at]
            at = np.where((symbols >> bit) & 1 == 1, self.n - ones[-1] + one, at - one)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before row `at` of the transform."""
        return self._follow(symbols, at) - self.start[symbols]

    def step_back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one symbol earlier."""
        at, symbols = rows, np.zeros(len(rows), np.int64)
        for bit, ones in zip(self.bits, self.ones, strict=True):
            one = ones[at]
            is_one = ones[at + 1] > one
            symbols |= is_one.astype(np.int64) << bit
            at = np.where(is_one, self.n - ones[-1] + one, at - one)
        return self.first_row[symbols] + at - self.start[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (one a row of the matrix)."""
        m = len(phrases)
        low, high, alive = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.arange(m)
        known = self.first_row.shape[0] - 1
        for column in phrases.T[::-1]:
            symbols = column[alive]
            inside = symbols < known
            low[alive[~inside]] = high[alive[~inside]] = 0
            alive, symbols = alive[inside], symbols[inside]
            low[alive] = self.first_row[symbols] + self.rank(symbols, low[alive])
            high[alive] = self.first_row[symbols] + self.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        low[np.setdiff1d(np.arange(m), alive, assume_unique=True)] = 0
        high[np.setdiff1d(np.arange(m), alive, assume_unique=True)] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, walked, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows[left]]
            hit = left[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + walked
            left = left[~done]
            rows[left] = self.step_back(rows[left])
            walked += 1
        return out
