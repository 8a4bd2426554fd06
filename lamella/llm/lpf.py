"""Suffix order and longest previous factors of a block of bytes, in numpy.

Ranks of prefixes of 8, 16, ... bytes come from doubling; from them both the suffix order and the common prefix of any
two positions. The longest previous factor of a position is the longer of its common prefixes with the previous and
the next position, in suffix order, that is smaller in the text.
"""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    return out


class Ranks:
    """Ranks of the 8 * 2**k-byte strings at each position of data (cut at its end), up to those of ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        if depth < 8:
            raise ValueError("strings of fewer than eight bytes are not ranked")
        n = len(data)
        wide = np.zeros(n, np.uint64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(8):
            wide = (wide << np.uint64(8)) | padded[k : k + n]
        self.n, self.sizes, self.ranks = n, [8], [_dense(wide) + 1]
        while self.sizes[-1] * 2 <= depth:
            size, r = self.sizes[-1], self.ranks[-1]
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = r[size:]
            self.ranks.append(_dense(r * (n + 2) + after) + 1)
            self.sizes.append(size * 2)

    def order(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The positions in at, which have depth bytes or more, by those bytes and then by place."""
        at = np.sort(at)
        size, r = self.sizes[-1], self.ranks[-1]
        key = r[at] * (self.n + 2) + (r[at + depth - size] if depth > size else 0)
        return at[np.argsort(key, kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Common prefix of the strings at a and b in whole bytes, up to most (and to less than eight more than counted, short of most); both have so many bytes."""
        done = np.zeros(len(a), np.int64)
        for size, r in zip(self.sizes[::-1], self.ranks[::-1], strict=True):
            for _ in range(2 if size == self.sizes[-1] else 1):  # the largest may fit more than once
                fits = done + size <= most
                x, y = np.where(fits, a + done, 0), np.where(fits, b + done, 0)
                done += size * (fits & (r[x] == r[y]))
        end = np.flatnonzero((done < most) & (done + 8 > most))  # less than eight bytes are open: the last eight tell
        same = self.ranks[0][a[end] + most - 8] == self.ranks[0][b[end] + most - 8]
        done[end[same]] = most
        return done


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of suffix order the nearest one before it that is smaller in the text (-1: none with a common prefix of least) and the common prefix with it.

    All entries jump over larger ones at once; each jump takes its target's own pointer, so pointers grow by doubling.
    """
    n = len(place)
    to, low = np.arange(-1, n - 1), np.concatenate([[0], lcp]) if n else np.zeros(0, np.int64)
    low = low.copy()
    to[low < least] = -1
    live = np.flatnonzero((to >= 0) & (place[np.maximum(to, 0)] > place))
    while len(live):
        via = to[live]
        low[live] = np.minimum(low[live], low[via])
        to[live] = np.where(low[live] < least, -1, to[via])
        live = live[(to[live] >= 0) & (place[np.maximum(to[live], 0)] > place[live])]
    return to, np.where(to >= 0, low, 0)


class SuffixOrder:
    """Positions of data that have depth bytes, in suffix order, with the common prefixes of neighbours (compared up to depth)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, depth: int):
        ranks = Ranks(data, depth)
        self.depth, self.sa = depth, ranks.order(at, depth)
        self.lcp = ranks.common(self.sa[:-1], self.sa[1:], depth) if len(self.sa) else np.zeros(0, np.int64)
        self.back = np.argsort(self.sa, kind="stable")

    def nearest(self, later: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By suffix order: index of the previous and of the next entry that is smaller in the text (larger, with later), and the common prefix with each."""
        place = -self.sa if later else self.sa
        before, n1 = _nearest_smaller(place, self.lcp, self.depth)
        after, n2 = _nearest_smaller(place[::-1], self.lcp[::-1], self.depth)
        return before, n1, np.where(after[::-1] >= 0, len(place) - 1 - after[::-1], -1), n2[::-1]


def previous_factors(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in text order, length, source): for each position in at the longest match that starts at a smaller position in at.

    Lengths count up to least (that many bytes are compared), shorter ones are 0; the source is a smaller position with that match, else -1.
    """
    o = SuffixOrder(data, at, least)
    before, n1, after, n2 = o.nearest()
    length = np.maximum(n1, n2)
    source = np.where(length > 0, o.sa[np.where(n1 >= n2, before, after)] if len(o.sa) else 0, -1)
    return o.sa[o.back], length[o.back], source[o.back]


def repeated(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in text order, has an earlier match, has a later match) of least bytes: longest previous factors, and their mirror image."""
    o = SuffixOrder(data, at, least)
    (b1, _, a1, _), (b2, _, a2, _) = o.nearest(), o.nearest(later=True)
    return o.sa[o.back], ((b1 >= 0) | (a1 >= 0))[o.back], ((b2 >= 0) | (a2 >= 0))[o.back]
