"""Minima of hashed sets (minwise hashing), vectorised over whole Arrow batches: bands for candidates, packed low bits for estimates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed(codes: np.ndarray) -> np.ndarray:
    """A 32-bit mixing of piece codes; every fingerprint starts from it."""
    h = codes.astype(np.uint32) + np.uint32(0x9E3779B9)
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(mul)
    return h ^ (h >> np.uint32(16))


def distinct(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes (below 2^32) of each text in ascending order, and how many each text has."""
    codes, ends = codes.astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])
    at = ends.tolist()
    for a, b in zip(at, at[1:]):  # texts that fit the CPU's cache, sorted in place
        codes[a:b].sort()
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return codes[new], np.diff(before[ends])


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(h: np.ndarray, counts: np.ndarray, scale: np.ndarray | None, n: int, seed: int, block: int = 1 << 16) -> np.ndarray:
    """n weighted minima for each set (rows, n) as 32-bit patterns; scale is 1/weight of each element, None for equal weights.

    The minimum of u/weight falls on an element with a probability in proportion to its weight, so two sets share a
    minimum about as often as their weighted Jaccard similarity. Empty sets get zeros.
    """
    out = np.zeros((len(counts), n), np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out.view(np.uint32)
    mul, size = odd_multipliers(n, seed), counts[full]
    ends = np.cumsum(size)
    first = 0
    while first < len(full):  # blocks of sets that fit the CPU's cache
        start = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, start + block, "right")))
        own, at = h[start : ends[last - 1]], ends[first:last] - size[first:last] - start
        w = None if scale is None else scale[start : ends[last - 1]]
        rows = full[first:last]
        for k in range(n):
            v = (own * mul[k]).astype(np.float32)
            if w is not None:
                v *= w
            out[rows, k] = np.minimum.reduceat(v, at)
        first = last
    return out.view(np.uint32)


def low_bits(m: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed: 32 minima in each signed 64-bit number."""
    two = ((m * np.uint32(2654435761)) >> np.uint32(30)).astype(np.uint8)
    four = two.reshape(len(m), -1, 4)
    return np.ascontiguousarray((four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6).astype(np.uint8)).view(np.int64)


def band_keys(m: np.ndarray, bands: int, width: int) -> np.ndarray:
    """32-bit hashes of `bands` groups of `width` minima each."""
    key = np.zeros((len(m), bands), np.uint32)
    for i in range(width):
        key = (key ^ m[:, i * bands : (i + 1) * bands]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
    return key.view(np.int32)


def unequal(x: Column, y: Column) -> Column:
    """How many of the 32 two-bit values of two longs differ, by bit counts."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def estimate(differing: Column, n: int) -> Column:
    """Similarity estimated from n two-bit minima, corrected for the quarter that agree by chance."""
    return ((F.lit(n) - differing) / F.lit(float(n)) - 0.25) / 0.75
