"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as larger or smaller than their successor; the leftmost-smaller ones are sorted by the
substrings between them, named, and the string of their names is sorted in turn; from their order that of all others
is induced in two linear sweeps. A sweep goes from one first character to the next and moves all suffixes of
a bucket at once.

Texts are arrays of small numbers that end in a zero, which occurs nowhere else. Suffixes are told apart to `depth`
numbers: those that agree so far may stand in any order.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    # A run of equal characters has the type of its last one.
    at = np.searchsorted(differs, np.arange(n))
    ends = np.append(differs, n - 1)[at]
    types = np.ones(n, bool)
    inner = ends < n - 1
    types[inner] = s[ends[inner]] < s[ends[inner] + 1]
    return types


class _Buckets:
    """Suffixes waiting for the sweep to reach their first character."""

    def __init__(self, size: int):
        self.lists: list[list[np.ndarray]] = [[] for _ in range(size)]

    def put(self, s: np.ndarray, found: np.ndarray) -> None:
        if not len(found):
            return
        chars = s[found]
        order = np.argsort(chars, kind="stable")
        found = found[order]
        ends = np.cumsum(np.bincount(chars, minlength=len(self.lists)))
        used = np.flatnonzero(np.diff(np.r_[0, ends]))
        for c in used:
            self.lists[c].append(found[(ends[c - 1] if c else 0) : ends[c]])

    def take(self, c: int) -> np.ndarray:
        waiting, self.lists[c] = self.lists[c], []
        return np.concatenate(waiting) if waiting else np.empty(0, np.int64)


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in theirs."""
    size = int(s.max()) + 1
    starts, larger = _Buckets(size), _Buckets(size)
    starts.put(s, lms)
    large: list[np.ndarray] = []
    # Upwards: what stands before a suffix and is larger than it comes into order.
    for c in range(size):
        now = larger.take(c)
        mine, out = [now], []
        while len(now):
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            same = s[before] == c
            now = before[same]
            mine.append(now)
            out.append(before[~same])
        first = starts.take(c)
        before = first[first > 0] - 1
        out.append(before[~smaller[before]])
        larger.put(s, np.concatenate(out))
        large.append(np.concatenate(mine))
    # Downwards: the smaller ones, each bucket from its end.
    waiting, done = _Buckets(size), []
    for c in range(size - 1, -1, -1):
        now = waiting.take(c)
        if c == 0:
            now = np.array([len(s) - 1])
        mine, out = [now], []
        while len(now):
            before = now[now > 0] - 1
            before = before[smaller[before]]
            same = s[before] == c
            now = before[same]
            mine.append(now)
            out.append(before[~same])
        down = large[c][::-1]
        before = down[down > 0] - 1
        out.append(before[smaller[before]])
        waiting.put(s, np.concatenate(out))
        done += [np.concatenate(mine), down]
    return np.concatenate(done)[::-1]


def _names(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Numbers of the substrings between leftmost-smaller suffixes, in order of place, equal for equal ones."""
    n = len(s)
    stop = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = stop - lms
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    active = np.flatnonzero(same)
    step = 0
    while len(active):
        x, y = a[active] + step, b[active] + step
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        equal = (s[x] == s[y]) & (smaller[x] == smaller[y])
        same[active[~equal]] = False
        active = active[equal]
        step += 1
        active = active[length[a[active]] >= step]
    number = np.zeros(n, np.int64)
    number[ordered] = np.r_[0, np.cumsum(~same)]
    return number[lms]


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names, by doubling the length that is told apart. A name stands
    for two characters at least."""
    rank, reach = names, 1
    while 2 * reach < depth and int(rank.max()) + 1 < len(rank):
        follows = np.zeros(len(rank), np.int64)
        if reach < len(rank):
            follows[:-reach] = rank[reach:] + 1
        _, rank = np.unique(rank * (int(rank.max()) + 2) + follows, return_inverse=True)
        reach *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in order, told apart to `depth` numbers."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    smaller = smaller_types(s)
    lms = np.flatnonzero(np.r_[False, smaller[1:] & ~smaller[:-1]])
    by_substring = induce(s, smaller, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    names = _names(s, smaller, lms, by_substring[is_lms[by_substring]])
    if int(names.max()) + 1 == len(lms):
        order = np.argsort(names)
    else:
        order = _rank(names, depth)
    return induce(s, smaller, lms[order])


def permuted_common_prefixes(data: np.ndarray, before: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to `depth` bytes, of what begins at each of `places` and at its `before`; both have that
    many bytes left."""
    words = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    common = np.zeros(len(places), np.int64)
    active = np.arange(len(places))
    at = 0
    while at < depth and len(active):
        step = min(8, depth - at)
        mixed = words[places[active] + at] ^ words[before[active] + at]
        if step < 8:
            mixed = mixed & np.uint64((1 << (8 * step)) - 1)
        equal = mixed == 0
        off = mixed[~equal]
        # The lowest byte that differs comes first.
        low = np.bitwise_count((off & (~off + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        common[active[~equal]] = at + low
        active = active[equal]
        at += step
    common[active] = depth
    return common
