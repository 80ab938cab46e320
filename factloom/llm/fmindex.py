"""A compressed FM-index over sequences of symbols: bit vectors of a wavelet matrix over the Burrows-Wheeler transform.

Suffixes are sorted to the depth of the longest pattern only, which backward search of such patterns needs no more than.
All searches run side by side in numpy.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        words[: len(packed)] = packed
        self.words = words.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by their first `depth` symbols at least."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        if step == 1:
            key = rank
        else:
            after = np.zeros(n, np.int64)
            after[: n - step // 2] = rank[step // 2 :] + 1
            key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        if step >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        step *= 2


class FMIndex:
    """Over sequences of symbols from 1 on, each followed by a 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.sigma = len(text), int(text.max(initial=0)) + 1
        self.order = suffix_order(text, depth)
        last = text[self.order - 1]  # the symbol before each suffix; the text counts as a ring
        self.smaller = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.smaller[1:])
        self.levels, self.zeros = [], []
        for b in reversed(range(max(1, (self.sigma - 1).bit_length()))):
            bits = (last >> b & 1).astype(bool)
            self.levels.append((b, Bits(bits)))
            self.zeros.append(int(self.n - bits.sum()))
            last = np.concatenate([last[~bits], last[bits]])
        symbols = np.arange(self.sigma)
        self.origin = np.zeros(self.sigma, np.int64)
        self.origin = self._descend(symbols, np.zeros(self.sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (b, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes in the transform before each position."""
        return self._descend(symbol, at) - self.origin[symbol]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes for each pattern with a symbol put before it."""
        return self.smaller[symbol] + self.rank(symbol, low), self.smaller[symbol] + self.rank(symbol, high)

    def matching(self, text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end (exclusive) in text the longest match that ends there, up to `longest` symbols and its suffix interval.

        Symbols that are 0 or unknown to the index (too large) match nothing."""
        size = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        alive = np.arange(len(ends))
        for j in range(1, longest + 1):
            alive = alive[ends[alive] >= j]
            symbol = text[ends[alive] - j]
            known = (symbol > 0) & (symbol < self.sigma)
            alive, symbol = alive[known], symbol[known]
            lo, hi = self.step(symbol, low[alive], high[alive])
            found = hi > lo
            alive = alive[found]
            low[alive], high[alive], size[alive] = lo[found], hi[found], j
        return size, low, high
