"""Suffix order of many word sequences at once by prefix doubling, neighbours' common prefixes, and range minima."""

from __future__ import annotations

import numpy as np


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each place the place of the last True up to it."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    """Longest common extensions of suffixes of one array that holds several sequences; none reaches over a sequence's end.

    words: a number for each word; equal words of different sequences have different numbers. end: for each place, the end
    of its sequence. Each round orders suffixes by twice as many words, among those that still tie; the ranks of a round
    tell which places start with the same 2^k words, and the common prefixes of neighbours in suffix order come from those.
    """

    def __init__(self, words: np.ndarray, end: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        new = np.r_[True, words[order[1:]] != words[order[:-1]]]
        rank = np.empty(n, np.int64)
        rank[order] = _firsts(new)
        levels, reach, open_ = [rank], 1, order[~(new & np.r_[new[1:], True])]
        while len(open_):
            ahead = open_ + reach
            inside = ahead < end[open_]
            key = rank[open_] * (n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            old = rank[open_]
            new = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[open_] = old + _firsts(new) - _firsts(np.r_[True, old[1:] != old[:-1]])
            levels.append(rank)
            open_ = open_[~(new & np.r_[new[1:], True])]
            reach *= 2
        self.rank = rank
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        common, some = np.zeros(max(n - 1, 0), np.int64), np.arange(n - 1)
        x, y = place[:-1].copy(), place[1:].copy()
        some = some[levels[0][x] == levels[0][y]]  # others share no word
        x, y = x[some], y[some]
        for k in range(len(levels) - 1, -1, -1):
            inside = (x < end[place[some]]) & (y < end[place[some + 1]])
            same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
            step = same.astype(np.int64) << k
            common[some] += step
            x, y = x + step, y + step
        self.common = common

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b (a <> b) have in common: the minimum of neighbours' common prefixes between their ranks.

        The table of minima over 2^k neighbours is built a row at a time, each answering the queries of its width.
        """
        ranks = np.sort(np.stack([self.rank[a], self.rank[b]]), axis=0)
        low, width = ranks[0], ranks[1] - ranks[0]
        level = np.frexp(width.astype(np.float64))[1] - 1
        out, least = np.zeros(len(low), np.int64), self.common
        by = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by], np.arange(level.max(initial=-1) + 2))
        for k in range(len(cuts) - 1):
            q = by[cuts[k] : cuts[k + 1]]
            out[q] = np.minimum(least[low[q]], least[low[q] + width[q] - (1 << k)])
            if k + 2 < len(cuts):
                least = np.minimum(least[: -(1 << k)], least[1 << k :])
        return out
