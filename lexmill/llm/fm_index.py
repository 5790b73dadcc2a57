"""An FM-index over integer symbols with a wavelet matrix on packed bits, searched array-wise."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit; each level is bits in words with a count before each word."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n = len(symbols)
        self.levels = []
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            words = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32)
            zeros = self.n - int(bit.sum())
            self.levels.append((level, words, before, zeros))
            s = np.concatenate([s[~bit], s[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` ends up after all levels along each symbol; differences of it are ranks."""
        one = np.uint64(1)
        for level, words, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((one << (at & 63).astype(np.uint64)) - one))
            at = np.where(symbols >> level & 1, zeros + ones, at - ones).astype(np.int32)
        return at


class FMIndex:
    """Backward search for patterns of up to `depth` symbols in a text of symbols 0..size-1 whose last symbol is in no pattern.

    Suffixes are ordered by their first `depth` symbols only, which is all that patterns so short can tell apart. The
    order itself is not kept: of each suffix there is only the label of its place (its document, say), in `labels`.
    """

    def __init__(self, text: np.ndarray, depth: int, labels: np.ndarray):
        n = len(text)
        self.size = int(text.max()) + 1 if n else 1
        rank, width = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            key = rank * (n + self.size + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            steps = key[order]
            new[order] = np.concatenate([[0], np.cumsum(steps[1:] != steps[:-1])])
            rank, width = new, width * 2
            if rank[order[-1]] == n - 1:
                break
        self.labels = labels[order].astype(np.int32)
        levels = max(1, (self.size - 1).bit_length())
        self.tree = WaveletMatrix(text[order - 1], levels)
        every = np.arange(self.size)
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))[:-1]])
        self.base = (starts - self.tree.descend(every, np.zeros(self.size, np.int32))).astype(np.int32)
        self.n = n

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix intervals of symbol + pattern from those of the patterns."""
        both = self.tree.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.base[symbols]
        return base + both[: len(symbols)], base + both[len(symbols) :]


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, limit: int, own: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end position in text, the longest match ending there that occurs in the index at least `own` times, up to `limit` symbols: its length and its suffix interval."""
    low, high = np.zeros(len(ends), np.int32), np.full(len(ends), index.n, np.int32)
    length = np.zeros(len(ends), np.int32)
    live = np.arange(len(ends))
    for t in range(limit):
        at = ends[live] - t
        live, at = live[at >= 0], at[at >= 0]
        if not len(live):
            break
        lo, hi = index.extend(text[at], low[live], high[live])
        some = hi - lo >= own
        live = live[some]
        low[live], high[live] = lo[some], hi[some]
        length[live] = t + 1
    return length, low, high
