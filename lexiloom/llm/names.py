"""Names that no list holds, learned from context.

Candidates are runs of two or more capitalised words (initials and particles between them) of which none is an ordinary
word: none stands in small letters in the vocabularies of public tokenizers or, but as an exception, in the corpus. What stands around names that
senders' names, titles and salutations give away is learned from all texts of the corpus: a logistic regression on the
words before and after, boundaries and the language. A candidate is a name if the model says so.

Defined results: texts in capitals only or small letters only have no candidates. A corpus without names, or without other
candidates, gives a model that accepts nothing. Slopes are added up in whole units, so that repeated runs agree however the
rows are dealt to tasks.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.runtime import cut

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_CELLS = 1 << 14
_KEPT, _RUNS = 1 << 18, 1 << 16  # pieces, and words or runs, that a task remembers
_UNIT = 1 << 20  # chances and slopes are added up in units of 1 / _UNIT
_ROWS = 200_000  # distinct rows a task of a round, which costs little but its start
_PART = r"(?:(?:van|von|de|del|der|den|di|da|la|le|ter|ten|bin|al|dos|du|zu|zur)\s)"
_CAP = r"\p{Lu}[\p{L}\p{M}'’-]+"
RUN = regex.compile(rf"(?<![\w@.'’/&-])(?:\p{{Lu}}\. )*{_CAP}(?:[^\S\n]{_PART}{{0,2}}(?:\p{{Lu}}\.|{_CAP}))+(?![\w@])")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*")
_SMALL = regex.compile(r"(?<![\w@./:'’&=?_-])\p{Ll}[\p{Ll}\p{M}]+(?![\w@/:&=_-]|\.\w)")  # no parts of addresses
_CASED = regex.compile(r"\p{Lu}\p{Ll}")
# The same for pieces of ASCII only.
_SMALL_ASCII = re.compile(r"(?<![\w@./:'&=?_-])[a-z][a-z]+(?![\w@/:&=_-]|\.\w)", re.ASCII)
_WORD_ASCII = re.compile(r"[A-Za-z][A-Za-z'-]*")
_CASED_ASCII = re.compile(r"[A-Z][a-z]")
# Frequent words that tell the language of a text.
_TELLS = {"de": {"und", "die", "der", "nicht", "für", "ist"}, "fr": {"et", "les", "des", "vous", "est", "pour"}, "es": {"y", "los", "las", "que", "por", "el"}, "en": {"the", "and", "of", "to", "is", "for"}}


def vocabulary(paths: tuple[str, ...] = VOCABULARIES) -> set[str]:
    """Words in small letters that are one token of a public vocabulary, with a blank before it. Missing files add nothing."""
    out = set()
    for path in paths:
        if os.path.exists(path):
            with open(path, "rb") as lines:
                for line in lines:
                    word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                    if word[:1] == " " and word[1:].isalpha() and word[1:].islower() and len(word) > 2:
                        out.add(word[1:])
    return out


_TOLD = {w: tuple(k for k, own in _TELLS.items() if w in own) for own in _TELLS.values() for w in own}


def _language(words: list[str]) -> str:
    """The language that words in small letters tell."""
    return _most(map(_TOLD.__getitem__, filter(_TOLD.__contains__, words)))


def _most(told: Iterable[tuple[str, ...]]) -> str:
    found = Counter(chain.from_iterable(told))
    return max(found, key=lambda k: (found[k], k)) if found else ""


class NameModel:
    def __init__(self, ordinary: set[str], weights: np.ndarray | None = None, least: float = 0.75):
        self.ordinary, self.weights, self.least = ordinary, weights, least
        self.given: list[str] = []
        self._common: dict[str, bool] = {}
        self._inner: dict[str, list[tuple[int, int]]] = {}

    def more(self, words: set[str]) -> None:
        """These words are ordinary too."""
        self.ordinary |= words
        self._common.clear()
        self._inner.clear()

    def common(self, word: str) -> bool:
        made = self._common.get(word)
        if made is None:
            if len(self._common) > _RUNS:
                self._common.clear()
            made = self._common[word] = self._is_common(word)
        return made

    def _is_common(self, word: str) -> bool:
        low = word.lower().strip("'’-")
        return low in self.ordinary or any(len(p) > 1 and p in self.ordinary for p in low.replace("’", "-").replace("'", "-").split("-"))

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Spans of uncommon capitalised words, two or more, inside runs of capitalised words."""
        return [span for m in RUN.finditer(text) for span in self._within(text, *m.span())] if _CASED.search(text) else []

    def _within(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        run = text[start:end]
        made = self._inner.get(run)
        if made is None:
            if len(self._inner) > _RUNS:
                self._inner.clear()
            made = self._inner[run] = self._parts(run)
        return [(start + a, start + b) for a, b in made]

    def _two(self, run: str) -> bool:
        return sum(not self.common(w) for w in run.split() if w[0].isupper()) >= 2

    def _parts(self, text: str) -> list[tuple[int, int]]:
        """The candidates of a run."""
        out: list[tuple[int, int]] = []
        if not self._two(text):
            return out
        words = [w for w in _WORD.finditer(text) if w.group()[0].isupper()]
        good = [len(w.group()) == 1 or not self.common(w.group()) for w in words]
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and good[j]:
                j += 1
            full = [w for w in words[i:j] if len(w.group()) > 1]
            if len(full) > 1 or full and j - i > 1:
                follows = j < len(words)  # an ordinary word in capitals after it makes it an organisation
                if not follows:
                    out.append((words[i].start(), words[j - 1].end() + (text[words[j - 1].end() : words[j - 1].end() + 1] == "." and len(words[j - 1].group()) == 1)))
            i = max(j, i + 1)
        return out

    def _cells(self, text: str, a: int, b: int, language: str) -> list[int]:
        left, right = _WORD.findall(text[max(0, a - 60) : a].rpartition("\n")[2].lower()), _WORD.findall(text[b : b + 40].partition("\n")[0].lower())
        l1, r1 = left[-1] if left else "", right[0] if right else ""
        before, after = text[a - 2 : a].strip(" "), text[b : b + 1]
        edge = "^" if a == 0 or before[-1:] == "\n" else before[-1:] if before[-1:] in ".!?,:;(–-" else "w"
        said = [f"l:{l1}", f"ll:{' '.join(left[-2:])}", f"r:{r1}", f"e:{edge}", f"z:{after if after in '.,:;)' else 'n' if after == chr(10) or not after else 'w'}", f"g:{language}", f"ge:{language}{edge}", f"n:{min(4, text.count(' ', a, b))}", f"lr:{l1}>{r1}", "bias"]
        return [zlib.crc32(s.encode()) % _CELLS for s in said]

    def names(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Candidates that overlap nothing taken and that the model calls names."""
        if self.weights is None:
            return []
        spans = [(a, b) for a, b in self.candidates(text) if not any(a < y and x < b for x, y in taken)]
        if not spans:
            return []
        language = _language(text.lower().split())
        return [(a, b) for a, b in spans if 1 / (1 + np.exp(-self.weights[self._cells(text, a, b, language)].sum())) >= self.least]


    def spans(self, text: str) -> list[tuple[int, int]]:
        """Runs of capitalised words with two uncommon ones; more common words never give more of them."""
        return [m.span() for m in RUN.finditer(text) if self._two(m.group())] if _CASED.search(text) else []

    def runs(self, text: str, items: list[tuple[int, int, str]], met: list[tuple[int, int]], language: str | None = None) -> list[tuple]:
        """(surroundings, start and end in them, items that it meets, language) of each of `met`, the spans(): all that candidates in it are judged by."""
        if met and language is None:
            language = _language(text.lower().split())
        lows = [max(0, a - 60) for a, _ in met]
        return [(text[low : b + 41], a - low, b - low, [(x - low, y - low, kind) for x, y, kind in items if x <= b and a < y], language) for low, (a, b) in zip(lows, met)]

    def openers(self, text: str, start: int, end: int, items: list[tuple[int, int, str]], language: str) -> Iterator[str]:
        """Words in capitals that stand before known names in a run: they are no part of them."""
        for a, b in self._within(text, start, end):
            inside = [x for x, y, kind in items if kind == "NAME" and a < x < b and text[x + 1 : x + 2] != "."]
            if inside:
                yield from (w for w in _WORD.findall(text[a : min(inside)]) if len(w) > 1)

    def rows(self, text: str, start: int, end: int, items: list[tuple[int, int, str]], language: str) -> Iterator[tuple[list[int], bool, str]]:
        """(cells, whether it is a known name, first word but for an initial) of each candidate of a run that is nothing else that is known."""
        for a, b in self._within(text, start, end):
            kinds = {kind for x, y, kind in items if x < b and a < y}
            if kinds <= {"NAME"}:
                first = _WORD.match(text, a, b).group()
                yield self._cells(text, a, b, language), bool(kinds), first if len(first) > 1 else ""  # what follows an initial is no given name


_NONE: tuple = (0, (), ())


class _Pieces(dict):
    """(parts in mixed case, new words in small letters, those in capitals, languages told) of pieces between blanks; None if nothing."""

    def __init__(self, ordinary: set[str]):
        super().__init__()
        self.ordinary = ordinary

    def __missing__(self, piece: str) -> tuple | None:
        if len(self) > _KEPT:
            self.clear()
        made = (*self._of(piece), _TOLD.get(piece.lower(), ()))
        self[piece] = made = made if any(made) else None
        return made

    def _of(self, piece: str) -> tuple[int, tuple[str, ...], tuple[str, ...]]:
        known = self.ordinary
        if piece.strip("£€“”–…").isascii():
            low, high = piece.lower(), piece.upper()
            if low == high:
                return _NONE
            if piece.isalpha() and (piece == low or piece.istitle()):  # what the patterns below say of it
                new = low not in known
                return (0, (piece,) if new and len(piece) > 1 else (), ()) if low == piece else (int(len(piece) > 1), (), (piece,) if new else ())
            small = tuple(w for w in (_SMALL_ASCII.findall(piece) if piece != high else ()) if w not in known)
            large = tuple(w for w in (_WORD_ASCII.findall(piece) if piece != low else ()) if w[0].isupper() and w.lower() not in known)
            return len(_CASED_ASCII.findall(piece)) if low != piece != high else 0, small, large
        small = tuple(w for w in _SMALL.findall(piece) if w not in known)
        large = tuple(w for w in _WORD.findall(piece) if w[0].isupper() and w.lower() not in known)
        return len(_CASED.findall(piece)), small, large


class Words:
    """In how many texts a word stands in small letters, in how many forms and texts in capitals, and whether in runs.

    Words that the model calls common already are left out. Neither a word nor what decides about it crosses a blank, so
    that each piece between blanks is looked at once.
    """

    def __init__(self, model: NameModel):
        self.small, self.large, self.inside = Counter(), Counter(), set()
        self.pieces, self.met, self.said = _Pieces(model.ordinary), set(), []

    def add(self, text: str) -> None:
        self.said = said = list(filter(None, map(self.pieces.__getitem__, text.split())))
        if sum([x[0] for x in said]) > 5:
            self.small.update({w for x in said if x[1] for w in x[1]})
            self.large.update(map(str.lower, {w for x in said if x[2] for w in x[2]}))

    def language(self) -> str:
        """The language of the text that was added last."""
        return _most([x[3] for x in self.said if x[3]])

    def meet(self, run: str) -> None:
        if run in self.met:
            return
        if len(self.met) > _RUNS:
            self.met.clear()
        self.met.add(run)
        for word in run.split():
            low = word.lower().strip("'’-")
            self.inside.update({low, *low.replace("’", "-").replace("'", "-").split("-")})

    def taken(self) -> Iterator[tuple[str, int, int, bool]]:
        """(word, small, large, inside) of all words, which are forgotten."""
        for word in self.small.keys() | self.large.keys() | self.inside:
            yield word, self.small[word], self.large[word], word in self.inside
        self.small, self.large, self.inside, self.met = Counter(), Counter(), set(), set()


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-w[x].sum(1)))


def _slope(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The slope of each cell in whole units, from rows that stand for n each."""
    off = np.rint((_chance(x, w) - y) * _UNIT) * n
    return np.bincount(x.ravel(), np.repeat(off, x.shape[1]), _CELLS).astype(np.int64)


def _weights(slope, total: int, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Adagrad on all rows: `slope` gives the summed slopes for weights."""
    w, square = np.zeros(_CELLS), np.full(_CELLS, 1e-8)
    for _ in range(rounds):
        gradient = decay * total * w / _CELLS + slope(w) / _UNIT
        square += gradient * gradient
        w = w - rate * gradient / np.sqrt(square)
    return w


FIT = {"rounds": 60, "rate": 0.5, "decay": 1e-3}
LEAST_SEEN = 3


def fit(texts: list[str], known, ordinary: set[str]) -> NameModel:
    """A model from texts and `known`, a function that gives the items (start, end, kind) of a text that need no model.

    Its `given` are first words of candidates that were names at least LEAST_SEEN times and in half of all cases.
    """
    model = NameModel(set(ordinary))
    words = Words(model)
    for text in texts:
        words.add(text)
    model.more({w for w, n, large, _ in words.taken() if n > 1 and n * 10 >= large})
    runs = [run for t in texts for run in model.runs(t, known(t), model.spans(t))]
    openers = Counter(w for run in runs for w in model.openers(*run))
    model.more({w.lower() for w, n in openers.items() if n > 2})
    rows = [row for run in runs for row in model.rows(*run)]
    y = np.array([known for _, known, _ in rows], np.float64)
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    x, one = np.array([cells for cells, _, _ in rows]), np.ones(len(y))
    model.weights = _weights(lambda w: _slope(x, y, one, w), len(y), **FIT)
    # names that no list holds count as others above; what known names score on average tells how many (Elkan and Noto)
    p = _chance(x, model.weights)
    model.least *= float(np.rint(p[y > 0] * _UNIT).sum() / y.sum() / _UNIT)
    seen, taken = Counter(first for _, _, first in rows), Counter(first for (_, _, first), own in zip(rows, p) if own >= model.least)
    model.given = sorted(first for first, n in taken.items() if first and n >= LEAST_SEEN and 2 * n >= seen[first])
    return model


def spans(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, str]]]:
    """The items (start, end, kind) of each row."""
    items = zip(*(batch.column(c).flatten().to_pylist() for c in ("starts", "ends", "kinds")))
    for n in pc.list_value_length(batch.column("starts")).fill_null(0).to_pylist():
        yield list(islice(items, n))


def learned(found: DataFrame, ordinary: set[str]) -> NameModel:
    """The model of a corpus: what fit() makes of all its texts, from their rows in personal.FOUND.

    What reaches the driver are the words of runs, the openers and the first words of names, which grow with the distinct
    words of such, and in each round the summed slopes of each task.
    """
    model = NameModel(set(ordinary))
    words = found.where("word is not null").groupBy("word").agg(F.sum("small").alias("n"), F.sum("large").alias("large"), F.max("inside").alias("inside"))
    model.more({r["word"] for r in words.where("inside and n > 1 and n * 10 >= large").select("word").toLocalIterator()})
    runs = found.where("language is not null").select("text", "a", "b", "starts", "ends", "kinds", "language")

    def told(batch: pa.RecordBatch) -> Iterator[tuple]:
        text, a, b, language = (batch.column(c).to_pylist() for c in ("text", "a", "b", "language"))
        return zip(text, a, b, spans(batch), language)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Counter(w for run in told(batch) for w in model.openers(*run))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    openers = runs.mapInArrow(opened, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 2")
    more = {r["word"].lower() for r in openers.toLocalIterator()}
    model.more(more)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = Counter((tuple(cells), known, first) for run in told(batch) for cells, known, first in model.rows(*run))
            cells, known, first = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in cells], pa.list_(pa.int32())), pa.array(known, pa.bool_()), pa.array(first, pa.string()), pa.array(list(made.values()), pa.int64())], ["cells", "known", "first", "n"])

    rows = cut(runs.mapInArrow(judged, "cells array<int>, known boolean, first string, n long").groupBy("cells", "known", "first").agg(F.sum("n").alias("n")), "candidates")
    size = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.when(F.col("known"), F.col("n"))).alias("known")).first()
    if not size["known"] or size["known"] == size["n"]:
        return model
    rows = rows.coalesce(-(-size["rows"] // _ROWS))

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n = batch.column("n").to_numpy()
        return batch.column("cells").flatten().to_numpy().reshape(len(n), -1), batch.column("known").to_numpy(zero_copy_only=False).astype(np.float64), n

    def slope(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sum((_slope(*parts(b), w) for b in batches if b.num_rows), np.zeros(_CELLS, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["slope"])

        return sum(np.frombuffer(r["slope"], np.int64) for r in rows.select("cells", "known", "n").mapInArrow(run, "slope binary").toLocalIterator())

    weights = model.weights = _weights(slope, size["n"], **FIT)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, _, _ = parts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("known"), batch.column("n"), pa.array(_chance(x, weights))], ["first", "known", "n", "p"])

    marks = cut(rows.mapInArrow(scored, "first string, known boolean, n long, p double"), "scored")
    model.least *= marks.where("known").agg(F.sum(F.rint(F.col("p") * _UNIT).cast("long") * F.col("n"))).first()[0] / size["known"] / _UNIT
    taken = marks.where("first <> ''").groupBy("first").agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("p") >= model.least, F.col("n"))).alias("n"))
    model.given = sorted(r["first"] for r in taken.where(F.col("n") >= LEAST_SEEN).where("2 * n >= seen").toLocalIterator())
    return model
