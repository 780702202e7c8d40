"""An FM-index over word symbols: suffix array, wavelet matrix with ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 32  #: every so many text positions the suffix array keeps one


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    k = 1
    while True:
        tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
        if not len(tied):
            return order
        sub = order[tied]
        follow = np.where(sub + k < n, rank[np.minimum(sub + k, n - 1)], -1)
        o = np.lexsort((follow, start[tied]))
        group, follow, sub = start[tied][o], follow[o], sub[o]
        order[tied] = sub
        first[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[sub] = start[tied]
        k *= 2


class Ranks:
    """Bit vector with rank: a count for each 64-bit word and a population count inside."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        inside = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(inside)


class FMIndex:
    """Index of a text of symbols 1.. with 0 as separator. Many patterns are searched at once."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        s = np.concatenate([text.astype(np.int64) + 1, [0]])  # the end is the smallest symbol
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.levels: list[tuple[int, Ranks, int]] = []
        top = int(s.max())
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        level = bwt
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            b = (level >> bit) & 1
            self.levels.append((bit, Ranks(b.astype(np.uint8)), int(len(b) - b.sum())))
            level = np.concatenate([level[b == 0], level[b == 1]])
        self.top = top
        marked = sa % sample == 0
        self.marks, self.kept = Ranks(marked.astype(np.uint8)), sa[marked]
        self.sample = sample

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c in the first i symbols of the transform."""
        lo, hi = np.zeros_like(i), i
        for bit, ranks, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = ranks.ones(lo), ranks.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def symbol(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at place i of the transform, and its rank there."""
        lo, at, c = np.zeros_like(i), i, np.zeros_like(i)
        for bit, ranks, zeros in self.levels:
            a, b, nxt = ranks.ones(lo), ranks.ones(at), ranks.ones(at + 1)
            one = nxt > b
            c |= one.astype(np.int64) << bit
            lo, at = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, at - b)
        return c, at - lo

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of suffixes that begin with each row of patterns (symbols 1..)."""
        p = patterns.astype(np.int64) + 1
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), self.n, np.int64)
        alive = (p <= self.top).all(1)
        live = np.flatnonzero(alive)
        for k in range(p.shape[1] - 1, -1, -1):
            c = p[live, k]
            lo[live], hi[live] = self.counts[c] + self.rank(c, lo[live]), self.counts[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        dead = np.ones(len(p), bool)
        dead[live] = False
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            before = self.marks.ones(r)
            hit = self.marks.ones(r + 1) > before
            out[open_[hit]] = self.kept[before[hit]] + steps[open_[hit]]
            open_, r = open_[~hit], r[~hit]
            c, k = self.symbol(r)
            rows[open_] = self.counts[c] + k
            steps[open_] += 1
        return out
