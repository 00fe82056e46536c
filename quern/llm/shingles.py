"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, to n at least."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 2 * n)
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+, A-Z lower-cased: a polynomial over the word's bytes, mixed."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text.translate(_FOLD), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([1], _BLANK[b].view(np.int8), [1]))))
    start, end = edges[0::2], edges[1::2]
    power, inverse = _power(len(b))
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[b] * power[: len(b)], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: bytes | None, size: int = 3) -> np.ndarray:
    """Distinct shingles, ascending. A text of fewer words is one shingle, of no words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * np.uint64(_R) + w[i : len(w) - k + 1 + i])
    return np.unique(h)
