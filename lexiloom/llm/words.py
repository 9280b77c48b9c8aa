"""Vectorised word kernels: words are runs of a-z and 0-9 of a text in match form; shingles are runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.llm.kernels import text_bytes

_PART = np.zeros(256, bool)
_PART[ord("a") : ord("z") + 1] = _PART[ord("0") : ord("9") + 1] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def folded(text: Column) -> Column:
    """Invisible characters dropped, look-alike letters folded; the rare texts that need it pay for it."""
    made = F.translate(F.regexp_replace(text, f"[{lexicons.INVISIBLE}]", ""), lexicons.LOOKALIKE_FROM, lexicons.LOOKALIKE_TO)
    return F.when(text.rlike(lexicons.FOLD_HINT), made).otherwise(text)


def match_form(text: Column) -> Column:
    return F.lower(folded(text))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(column: pa.Array, alike_numbers: bool = False, cues: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and how many each text has. Texts must be in match form.

    alike_numbers: all words with a digit are one word. cues: words alone in brackets and words after a cue are that word too.
    """
    raw, offs = text_bytes(column)
    part = _PART[raw]
    first = part.copy()
    first[1:] &= ~part[:-1]
    bounds = offs[(offs > 0) & (offs < len(raw))]
    first[bounds] = part[bounds]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    where = np.flatnonzero(part)
    word = np.cumsum(first)[where] - 1
    step = where - at[word]
    power = np.ones(int(step.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, _P, np.uint64), out=power[1:]) if len(power) > 1 else None
    value = (raw[where].astype(np.uint64) + np.uint64(1)) * power[step]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    h = _mix(np.add.reduceat(value, starts))
    if alike_numbers:
        h[np.logical_or.reduceat(raw[where] <= 57, starts)] = 0
    counts = np.searchsorted(at, offs[1:]) - np.searchsorted(at, offs[:-1])
    if cues:
        begins = np.zeros(len(h) + 1, bool)
        begins[np.cumsum(counts) - counts] = True
        follows = np.append(False, np.isin(h[:-1], hashed_words(pa.array([" ".join(cues)]))[0])) & ~begins[:-1]
        ends = np.append(where[starts[1:] - 1], where[-1]) + 1
        bracket = np.isin(raw[np.maximum(at - 1, 0)], (40, 91)) & (at > 0) & np.isin(np.append(raw, 0)[ends], (41, 93))
        h[follows | bracket] = 0
    return h, counts


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, the position of each in its text, and how many each text has."""
    per = np.maximum(counts - k + 1, 0)
    if len(h) < k or not per.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), per * 0
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = (s + h[j : len(h) - k + 1 + j]) * _P
        s ^= s >> np.uint64(29)
    start = np.cumsum(counts) - counts
    pos = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return _mix(s[np.repeat(start, per) + pos]), pos.astype(np.int32), per
