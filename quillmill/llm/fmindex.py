"""A compressed full-text index in numpy: Burrows-Wheeler transform, wavelet matrix, backward search.

The suffixes are sorted by prefix doubling, refining only groups that are still tied. The transform
is kept as a wavelet matrix whose bit vectors carry their own counts (32 bits and a running count
in each word), so that a rank is one gather and one population count per level. Backward search
runs for many patterns in step.
"""

from __future__ import annotations

import numpy as np

LOW = np.uint64(0xFFFFFFFF)
MASK = np.array([(1 << b) - 1 for b in range(32)], np.uint64)


def suffix_order(x: np.ndarray, sigma: int) -> np.ndarray:
    """The order of the suffixes of ``x`` (symbols below ``sigma``); a shorter suffix comes first."""
    n = len(x)
    bits = max(1, int(sigma).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):  # the first k symbols in one number; past the end counts as -1, shifted to 0
        part = np.zeros(n, np.int64)
        part[: max(0, n - j)] = x[j:].astype(np.int64) + 1
        key = key << bits | part
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(tied) and k < n:
        at = sa[tied]
        nxt = at + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[at]
        key = first << 32 | second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = head
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return sa


class FMIndex:
    """The index of several texts, each with an owner; symbols are 1.. and 0 parts the texts."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray) -> None:
        """codes: code points with 0 after each text; owner: the owner of each position."""
        self.alphabet = np.unique(codes)
        if not len(self.alphabet) or self.alphabet[0] != 0:
            self.alphabet = np.concatenate([np.zeros(1, codes.dtype), self.alphabet])
        x = np.searchsorted(self.alphabet, codes).astype(np.int32)
        self.sigma, self.n = len(self.alphabet), len(x)
        sa = suffix_order(x, self.sigma)
        bwt = x[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=self.sigma))])[:-1]
        self.owner = owner[sa]
        change = np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1
        change = np.append(change, self.n)
        #: for each place in the order the next one with another owner
        self.other = change[np.searchsorted(change, np.arange(self.n), "right")]
        self._wavelet(bwt)

    def _wavelet(self, bwt: np.ndarray) -> None:
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.words, self.zeros = [], []
        start = np.zeros(self.sigma, np.int64)
        symbols = np.arange(self.sigma)
        for shift in range(self.levels - 1, -1, -1):
            bit = (bwt >> shift & 1).astype(bool)
            padded = np.zeros((self.n // 32 + 1) * 32, bool)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint32).astype(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.uint64)[:-1]]).astype(np.uint64)
            self.words.append(ones << np.uint64(32) | packed)
            self.zeros.append(int(self.n - bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
            start = self._down(len(self.words) - 1, start, symbols >> shift & 1)
        self.offset = self.before - start

    def _down(self, level: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        word = self.words[level][at >> 5]
        ones = ((word >> np.uint64(32)) + np.bitwise_count(word & LOW & MASK[at & 31])).astype(np.int64)
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with one more symbol in front."""
        at = np.concatenate([lo, hi])
        two = np.concatenate([symbol, symbol])
        for level in range(self.levels):
            at = self._down(level, at, two >> (self.levels - 1 - level) & 1)
        at += self.offset[two]
        return at[: len(lo)], at[len(lo) :]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of code points, 0 for those that no text has."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), self.sigma - 1)
        return np.where(self.alphabet[at] == codes, at, 0)

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of backward search: the new ranges, and whether each holds a text of another owner."""
        lo, hi = self.step(symbol, lo, hi)
        first = np.minimum(lo, self.n - 1)
        return lo, hi, (symbol > 0) & (lo < hi) & ((self.owner[first] != owner) | (self.other[first] < hi))
