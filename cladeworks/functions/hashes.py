"""Hashes of all substrings of a text from sums over its prefixes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, x: np.uint64) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Prefixes:
    """Hashes of substrings of ``codes`` in constant time (modulo 2^64, by powers of an odd number)."""

    def __init__(self, codes: np.ndarray):
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        with np.errstate(over="ignore"):
            salted = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            salted ^= salted >> np.uint64(31)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted * _powers(len(codes), _ODD), dtype=np.uint64)])
        self.back = _powers(len(codes) + 1, inverse)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + length] - self.sums[start]) * self.back[start]


def windows(texts: list[str], k: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by a 0 character, the starts of all runs of ``k`` characters within one text, and their 64-bit hashes."""
    joined = "\0".join(t.replace("\0", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < k:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(codes == 0)])
    start = np.flatnonzero(ends[k:] == ends[:-k])
    return joined, start, Prefixes(codes).of(start, np.full(len(start), k))
