"""States of suffix automata of many pages at once.

Read backwards, a page has one automaton state for every set of starts that substrings share: the longest of them has
``len`` characters, is found at as many places as the set has members, and its suffix link is the next larger set. In the
sorted list of the page's suffixes such a set is an interval, its ``len`` the common prefix of the interval, its link the
interval around it. So one sort of all suffixes of a batch gives the states of all its pages without transition tables.
"""

from __future__ import annotations

from math import ceil

import numpy as np

from cladeworks.functions.hashes import Prefixes


def sorted_suffixes(codes: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order, common``: starts of the suffixes sorted within their pages, and the common prefix of each with the next one.

    Each page ends with a 0 that stands nowhere else in it. Common prefixes shorter than the first key are given as 0.
    """
    n = len(codes)
    bits = max(int(codes.max(initial=0)).bit_length(), 1)
    width = max((63 - int(page[-1]).bit_length()) // bits, 1) if n else 1
    width = min(width, 6)
    key = page.astype(np.int64)
    for i in range(width):
        key <<= bits
        key[: n - i] |= codes[i:]
    order = np.argsort(key)
    s = key[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]]) if n else np.zeros(0, bool)
    del key, s
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    common, hashed, length = np.zeros(n, np.int64), None, width
    while True:
        last = np.concatenate([fresh[1:], [True]]) if n else fresh
        at = np.flatnonzero(~(fresh & last))
        if not len(at):
            return order, common
        sub = order[at]
        k = (rank[sub] << 32) | rank[sub + length]
        o = np.argsort(k)
        sub, k = sub[o], k[o]
        order[at] = sub
        cut = np.concatenate([[True], k[1:] != k[:-1]])
        new = at[cut & ~fresh[at]]
        fresh[at[cut]] = True
        first = np.maximum.accumulate(np.where(cut, at, 0))
        rank[sub] = first
        if len(new):  # the suffix before each new border shares between length and 2 * length characters with it
            hashed = hashed or Prefixes(codes)
            a, b = order[new - 1], order[new]
            low = np.full(len(new), length, np.int64)
            step = length
            while step > 1:
                step = -(-step // 2)
                ok = (np.maximum(a, b) + low + step <= n) & (low + step < 2 * length)
                i = np.flatnonzero(ok)
                i = i[hashed.of(a[i], low[i] + step) == hashed.of(b[i], low[i] + step)]
                low[i] += step
            common[new - 1] = low
        length *= 2


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over each run of ``width`` values."""
    cur, size = x, 1
    while 2 * size <= width:
        cur = f(cur[:-size], cur[size:])
        size *= 2
    return f(cur[: len(x) - width + 1], cur[width - size :])


def longest_repeats(order: np.ndarray, common: np.ndarray, times: float) -> np.ndarray:
    """For each start the length of the longest substring there that its page has at least ``times`` times: its deepest such state."""
    n, t = len(order), max(2, ceil(times))
    out = np.zeros(n, np.int64)
    if n >= t:
        none = np.zeros(t - 1, np.int64)
        out[order] = _slide(np.concatenate([none, _slide(common[: n - 1], t - 1, np.minimum), none]), t, np.maximum)
    return out
