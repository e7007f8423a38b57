"""Words and their hashes over whole Arrow slices with NumPy: no Python loop over words."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: White space that separates words: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1 modulo 2^64; what was made is kept up to a size."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        out = np.full(max(n, 1), U(base))
        out[0] = 1
        held = np.multiply.accumulate(out)
        if n <= 1 << 22:
            _powers[base] = held
    return held[:n]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words, in text order. space: which bytes stand between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, scrambled."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(U))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, across row boundaries too; callers keep those within a row."""
    out = hashes[: max(0, len(hashes) - k + 1)].copy()
    for i in range(1, k):
        out = mix(out * U(3) + hashes[i : len(out) + i])
    return out


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 bounds of each row's words."""
    return np.searchsorted(rows, np.arange(n + 1))


def distinct_shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; a row of fewer words has its whole sequence as one, one without words none."""
    every = shingles(hashes, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(mix(shingles(hashes[a:b], b - a) + U(b - a)))
        else:
            out.append(hashes[:0])
    return out
