"""Vectorised rolling hashes over the bytes or the words of a text.

A prefix sum of value * M**position (mod 2**64, M odd) gives the hash of any stretch by one subtraction and a product
with the inverse power; a finaliser spreads the bits. Everything is fixed by SEED, so reruns and all executors agree.
"""

from __future__ import annotations

import numpy as np

SEED = 20240817
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
VALUES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def stretches(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], from their prefix p."""
    return mix((p[end] - p[start]) * powers(len(p))[1][start])


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values, from their prefix p."""
    n = len(p) - k
    return mix((p[k:] - p[:-k]) * powers(len(p))[1][:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


#: Space, tab, newline, VT, FF, CR.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the start and the end of each word."""
    ink = np.zeros(len(raw) + 2, np.int8)
    ink[1:-1] = ~_BLANK[raw]
    step = np.diff(ink)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    start, end = word_bounds(raw)
    return stretches(prefix(VALUES[raw]), start, end)
