"""Vectorised keys of texts, their five-character pieces and exact set similarity, on whole Arrow batches.

A key holds only a-z and 0-9, so a piece of five characters has an exact code below 37**5 (the 37th sign pads keys of
one to four characters, which have one piece, the key itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DROP, PAD, BASE, WIDTH = 255, 36, 37, 5
DIGIT = np.full(256, DROP, np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    DIGIT[_c] = _i
DIGIT[ord("A") : ord("Z") + 1] = np.arange(26)
_KELVIN, _DOTTED_I = "K", "İ"  # the only letters outside ASCII whose lower case holds an ASCII letter


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each, so that the arrays made from them stay small."""
    _, offs = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets of the texts in them; a null counts as an empty text."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def folded_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """text_bytes with the letters outside ASCII replaced whose lower case is an ASCII letter."""
    raw, offs = text_bytes(column)
    whole = raw.tobytes() if len(raw) else b""
    if _KELVIN.encode() in whole or _DOTTED_I.encode() in whole:
        column = pc.replace_substring(pc.replace_substring(pc.fill_null(column, ""), _KELVIN, "k"), _DOTTED_I, "i")
        raw, offs = text_bytes(column)
    return raw, offs


def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digits 0..35 of the keys of all texts and their offsets."""
    raw, offs = folded_bytes(column)
    digits = DIGIT[raw]
    keep = digits != DROP
    at = np.concatenate([[0], np.cumsum(keep)])
    return digits[keep], at[offs]


def pieces(digits: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the five-character pieces of all keys, in order with repeats, and how many each key has."""
    size = np.diff(offs)
    if ((size > 0) & (size < WIDTH)).any():
        parts, fill = [], np.full(WIDTH, PAD, np.uint8)
        for i, n in enumerate(size):
            own = digits[offs[i] : offs[i + 1]]
            parts.append(np.concatenate([own, fill[n:]]) if 0 < n < WIDTH else own)
        digits, size = np.concatenate(parts), np.where((size > 0) & (size < WIDTH), WIDTH, size)
        offs = np.concatenate([[0], np.cumsum(size)])
    if len(digits) < WIDTH:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    d = digits.astype(np.int32)
    codes = d[: 1 - WIDTH].copy()
    for j in range(1, WIDTH):
        codes *= BASE
        codes += d[j : len(d) - WIDTH + 1 + j]
    keep = np.ones(len(codes), bool)
    for j in range(1, WIDTH):
        end = offs[1:] - j
        end = end[(end >= 0) & (end < len(codes))]
        keep[end] = False
    return codes[keep], np.maximum(size - WIDTH + 1, 0)


def jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact similarity of each pair of texts: shared divided by all distinct pieces of their keys; 0 if a key is empty."""
    sides = []
    for column in (left, right):
        coded = pc.dictionary_encode(column)  # each text of a side is cut up once
        codes, counts = pieces(*keys(coded.dictionary))
        at = np.concatenate([[0], np.cumsum(counts)]).tolist()
        sides.append(([np.unique(codes[a:b]) for a, b in zip(at, at[1:])], pc.fill_null(coded.indices, -1).to_pylist()))
    (own_a, at_a), (own_b, at_b) = sides
    out = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(at_a, at_b)):
        if a >= 0 and b >= 0 and len(own_a[a]) and len(own_b[b]):
            both = np.concatenate([own_a[a], own_b[b]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / (len(both) - shared)
    return out
