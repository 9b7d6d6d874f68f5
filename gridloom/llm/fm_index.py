"""An FM-index over a text of small integers: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Backward search for patterns of at most `depth` symbols.

    Suffixes are sorted by their first `depth` or more symbols (by doubling), which is all that
    patterns of that length depend on. The transform is kept as a wavelet matrix: a bit vector for
    each bit of a symbol with counts every 64 bits. Searches run for many patterns at once.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:] + 1
            rank = np.unique(rank * (n + int(text.max(initial=0)) + 2) + after, return_inverse=True)[1]
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32 if n < 1 << 31 else np.int64)
        bwt = text[self.suffixes - 1]  # the symbol before the first is the last
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, bit.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of level k before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.ones[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        start = np.zeros_like(at)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            s, e = self._rank1(k, start), self._rank1(k, at)
            start, at = np.where(one, self.zeros[k] + s, start - s), np.where(one, self.zeros[k] + e, at - e)
        return at - start

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with the symbol and then with what [low, high) starts with."""
        both = self.ranks(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]

    def in_suffix_order(self, values: np.ndarray) -> np.ndarray:
        """Values of the text's positions in the order of their suffixes."""
        return values[self.suffixes]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, depth: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for each position: how many symbols of `text` that end there (it
        included) occur at `least` places of the index, `depth` at most, and the range of the suffixes
        that start with them. A search goes backward until fewer places are left."""
        low, high, length = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        on = np.flatnonzero(text[ends] + 1 < len(self.first))
        low[on], high[on] = self.first[text[ends[on]]], self.first[text[ends[on]] + 1]
        on = on[high[on] - low[on] >= least]
        length[on] = 1
        for k in range(1, depth):
            on = on[ends[on] >= k]
            on = on[text[ends[on] - k] + 1 < len(self.first)]  # a symbol that the index has
            a, z = self.extend(low[on], high[on], text[ends[on] - k])
            more = z - a >= least
            on, a, z = on[more], a[more], z[more]
            low[on], high[on], length[on] = a, z, k + 1
        return length, low, high

    def find(self, text: np.ndarray, starts: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns text[s : s + length]; empty where there are fewer than `least` suffixes."""
        got, low, high = self.matching_statistics(text, starts + length - 1, length, least)
        return np.where(got == length, low, 0), np.where(got == length, high, 0)
