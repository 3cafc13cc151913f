"""An FM-index in numpy: suffix sorting, a wavelet tree with rank blocks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order of text, whose symbols are in [1, sigma); a symbol 0 is taken to follow its end.

    The first sort packs as many symbols into a key as fit 62 bits; prefix doubling then sorts only what still ties.
    """
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    depth = max(1, min(62 // bits, n or 1))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] |= text[k:]
    sa = np.argsort(key, kind="stable")
    group = np.ones(n, bool)
    group[1:] = key[sa[1:]] != key[sa[:-1]]
    start = np.flatnonzero(group)
    rank = np.empty(n + 1, np.int64)  # rank of a suffix: the first place of its group, from 1; 0 past the end
    rank[n] = 0
    rank[sa] = np.repeat(start, np.diff(np.append(start, n))) + 1
    sizes = np.diff(np.append(start, n))
    places = np.repeat(sizes > 1, sizes).nonzero()[0]
    while len(places):
        at = sa[places]
        own = rank[at]
        follow = rank[np.minimum(at + depth, n)]
        order = np.lexsort((follow, own))
        at, own, follow = at[order], own[order], follow[order]
        sa[places] = at  # places of a group are consecutive and groups are in order
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(at)))
        rank[at] = np.repeat(places[start], sizes) + 1
        places = places[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return sa


class BitRank:
    """Bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Levelwise (matrix) wavelet tree: level k holds bit k of the symbols, those with 0 in front on the next level."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = (symbols >> k) & 1
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i entries."""
        start = np.zeros(len(symbol), np.int64)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            r_i, r_s = level.rank(i), level.rank(start)
            i = np.where(one, zeros + r_i, i - r_i)
            start = np.where(one, zeros + r_s, start - r_s)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at i, and its occurrences before i."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(i) == 1
            symbol = symbol * 2 + one
            r_i, r_s = level.rank(i), level.rank(start)
            i = np.where(one, zeros + r_i, i - r_i)
            start = np.where(one, zeros + r_s, start - r_s)
        return symbol, i - start


class FMIndex:
    """Index of text over symbols [1, sigma). Suffix positions are kept for every `sample`-th text position."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16) -> None:
        text = np.asarray(text, np.int64)
        self.n = len(text)
        sa = np.concatenate([[self.n], suffix_array(text, sigma)])  # the empty suffix comes first
        bwt = np.where(sa > 0, np.append(text, 0)[sa - 1], 0)  # 0 marks the row of the whole text
        self.tree = WaveletTree(bwt, sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])[: sigma + 1]
        kept = (sa % sample == 0)
        self.marked = BitRank(kept.astype(np.uint8))
        self.samples = sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns: one a row, right-aligned, `lengths` symbols of each count."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n + 1, np.int64)
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - k]
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the nearest sampled position."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.marked.get(rows) == 1
            out[todo[done]] = self.samples[self.marked.rank(rows[done])] + steps[todo[done]]
            todo, rows = todo[~done], rows[~done]
            steps[todo] += 1
            c, before = self.tree.access_rank(rows)
            rows = self.less[c] + before
        return out
