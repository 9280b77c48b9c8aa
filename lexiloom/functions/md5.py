"""MD5 of a text followed by each number of a range, vectorised: whole arrays go through the rounds of the digest at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_FULL = 0xFFFFFFFF
LOW = 4  # digits that vary inside a block


@cache
def _digits(n: int) -> np.ndarray:
    """The last n digits of 0 to 10**n - 1 as characters."""
    return (np.arange(10**n)[:, None] // 10 ** np.arange(n - 1, -1, -1) % 10 + 48).astype(np.uint8)


def _blocks(n: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """0 to n - 1 as (first number, leading characters, last characters); all numbers of a block have equally many digits."""
    for digits in range(1, LOW + 1):
        first = 10 ** (digits - 1) if digits > 1 else 0
        if first < n:
            yield first, b"", _digits(digits)[first:n]
    for first in range(10**LOW, n, 10**LOW):
        yield first, str(first)[:-LOW].encode(), _digits(LOW)[: n - first]


def _digest(head: bytes, tails: np.ndarray) -> list[np.ndarray]:
    size = len(head) + tails.shape[1]
    if size > 55:
        raise ValueError("texts of more than one block")
    raw = np.zeros((1, 64), np.uint8)
    raw[0, :size] = np.frombuffer(head + bytes(tails.shape[1]), np.uint8)
    raw[0, size] = 128
    raw[0, 56:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    words: list = [int(x) for x in raw.view("<u4")[0]]
    for w in range(len(head) // 4, (size - 1) // 4 + 1):  # the words that differ between the numbers
        own = np.repeat(raw[:, 4 * w : 4 * w + 4], len(tails), 0)
        for j in range(4):
            if 0 <= 4 * w + j - len(head) < tails.shape[1]:
                own[:, j] = tails[:, 4 * w + j - len(head)]
        words[w] = own.view("<u4").ravel().astype(np.uint32)
    a, b, c, d = (np.full(len(tails), x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _K[i]) & _FULL), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_K[i]), out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


def numbered(head: str, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """md5(head + str(i)) for 0 <= i < n in blocks: the first i, and the four numbers that each 8 hex digits stand for."""
    for first, lead, tails in _blocks(n):
        yield first, [x.byteswap() for x in _digest(head.encode() + lead, tails)]
