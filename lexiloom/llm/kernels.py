"""Vectorised fingerprints of texts: digests, weighted minima, similarity hashes and record trees, on whole Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from lexiloom.functions.minima import band_keys, distinct, low_bits, minima, mixed  # noqa: F401
from lexiloom.functions.pieces import DIGIT, DROP, folded_bytes, jaccard, keys, pieces, slices, text_bytes  # noqa: F401


def digests(digits: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """128-bit digest of each key as two signed 64-bit numbers."""
    whole = digits.tobytes()
    at = offs.tolist()
    out = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(at, at[1:]))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


_LABEL = np.zeros(256, bool)
_LABEL[ord("a") : ord("z") + 1] = _LABEL[ord("A") : ord("Z") + 1] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _blanks(raw: np.ndarray) -> np.ndarray:
    """Bytes of white space other than line feeds, that of several bytes included."""
    blank = _BLANK[raw]
    for seq in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF))):
        at = np.flatnonzero(raw == seq[0]) if seq[0] != 0xE2 or seq[2] in (0x80, 0x9F) else at
        hit = at[at + len(seq) <= len(raw)]
        for j in range(1, len(seq)):
            hit = hit[raw[hit + j] == seq[j]]
        for j in range(len(seq)):
            blank[hit + j] = True
    return blank


def _next(mask: np.ndarray) -> np.ndarray:
    """For each position, and one past the end, the first position from there on where the mask holds."""
    at = np.where(np.append(mask, True), np.arange(len(mask) + 1, dtype=np.int32), np.int32(len(mask)))
    return np.minimum.accumulate(at[::-1])[::-1]


def field_lines(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines of all texts, and which of them are field lines."""
    starts = np.unique(np.concatenate([offs[:-1], np.flatnonzero(raw == 10) + 1]))
    starts = starts[starts < len(raw)] if len(raw) else starts[:0]
    if not len(starts):
        return starts, np.zeros(0, bool)
    ends = np.append(starts[1:], len(raw))
    blank, letter = _blanks(raw), _LABEL[raw]
    ink = _next(~blank)
    label = ink[starts]
    stop = _next(~(letter | (raw == 32)))[label]
    inside = np.append(raw, 0)
    good = (label < ends) & np.append(letter, False)[label] & (stop < ends) & (stop - label <= 30) & np.isin(inside[stop], (58, 61))
    value = ink[np.minimum(stop + 1, len(raw))]
    return starts, good & (value < ends) & (inside[value] != 10) & (inside[value] != 47)


def _cut(digits: np.ndarray, counts: np.ndarray) -> list[bytes]:
    whole, at = digits.tobytes(), np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def trees(column: pa.Array) -> tuple[list[bytes], list[list[bytes]]]:
    """All texts as trees: the key of the body, and the keys of the field lines in ascending order."""
    raw, offs = folded_bytes(column)
    starts, fields = field_lines(raw, offs)
    n = len(offs) - 1
    digits = DIGIT[raw]
    text_of_line = np.searchsorted(offs, starts, "right") - 1
    in_field = np.repeat(fields, np.diff(np.append(starts, len(raw))))
    kept = digits != DROP
    at = kept & ~in_field
    before = np.concatenate([[0], np.cumsum(at, dtype=np.int64)])
    bodies = _cut(digits[at], before[offs[1:]] - before[offs[:-1]])
    inside = np.flatnonzero(kept & in_field)
    per_line = np.bincount(np.searchsorted(starts, inside, "right") - 1, minlength=len(starts))
    which = np.flatnonzero(per_line)
    leaves = _cut(digits[inside], per_line[which])
    owner = np.searchsorted(text_of_line[which], np.arange(n + 1)).tolist()
    return bodies, [sorted(leaves[a:b]) if b > a else [] for a, b in zip(owner, owner[1:])]


def roots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """128-bit root digests of the trees of all texts, which texts have content, and the trees in full as bytes.

    The root is the digest of the body's digest and the sorted digests of the field lines; 36 and above are no digits, so
    the full form tells body and lines apart.
    """
    bodies, leaves = trees(column)
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    made = b"".join(digest(digest(body) + b"".join(sorted(map(digest, own)))) for body, own in zip(bodies, leaves))
    full = np.array([bool(body or own) for body, own in zip(bodies, leaves)], bool)
    return np.frombuffer(made, np.int64).reshape(-1, 2), full, [bytes([255]).join([body, *own]) for body, own in zip(bodies, leaves)]


def simhash(h: np.ndarray, counts: np.ndarray, bits: int, seed: int, width: int = 1024, block: int = 4096) -> np.ndarray:
    """Similarity-hash fingerprints (rows, bits/8): signs of random projections of the sets' signed count sketches."""
    rng = np.random.default_rng(seed)
    plane = (rng.integers(0, 2, (width, bits), dtype=np.int8) * 2 - 1).astype(np.float32)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((len(counts), bits // 8), np.uint8)
    for first in range(0, len(counts), block):
        last = min(first + block, len(counts))
        own = h[ends[first] : ends[last]]
        cell = np.repeat(np.arange(last - first, dtype=np.int64) * width, counts[first:last]) + (own >> np.uint32(8)) % np.uint32(width)
        sign = np.where(own & np.uint32(1), 1.0, -1.0)
        sketch = np.bincount(cell, sign, (last - first) * width).reshape(last - first, width).astype(np.float32)
        out[first:last] = np.packbits(sketch @ plane > 0, axis=1)
    return out
