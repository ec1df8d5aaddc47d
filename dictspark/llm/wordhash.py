"""Vectorised 64-bit hashes of the words and word shingles of whole Arrow batches.

A word is a run of bytes other than space and \\t-\\r; A-Z are lower-cased. Its hash is a polynomial in an odd
multiplier over random values of its bytes, read off one prefix sum, and mixed at the end.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240613)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Instead of white space alone: every ASCII character but letters and digits.
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_MULTIPLIER = 0xD1342543DE82EF95
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 18
_TABLES: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, _SPAN)
        _TABLES[:] = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _TABLES.append(np.multiply.accumulate(out))
    return _TABLES


def words(raw: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each document's first word) for documents raw[bounds[i]:bounds[i + 1]]."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~gaps[raw]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(starts)
    ends = inside
    ends[:-1] &= ~(ends[1:] & ~edge[1:n])
    ends = np.flatnonzero(ends) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SPAN, side="right")))
        span = int(ends[to - 1] - base)
        power, inverse = _powers(span + 1)
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(_BYTE[raw[base : base + span]] * power[:span], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out), np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, in order, of the runs of width words; of all words where there are fewer; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width_ = min(width, n)
    total = np.zeros(n - width_ + 1, np.uint64)
    for k in range(width_):
        total = (total + hashes[k : n - width_ + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        total ^= total >> np.uint64(29)
    return np.unique(mix(total + np.uint64(width_)))
