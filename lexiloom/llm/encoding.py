"""Problem 5: text that was decoded with the wrong character encoding, in part or as a whole.

Characters are mapped back to the bytes of a legacy code page, an automaton for the byte structure of UTF-8 finds the
maximal well-formed multibyte spans among them, and only those spans are decoded; this repeats for text damaged more than
once. A sequence that a genuine text may hold (a word of another script in usual case, lines of a box, a capital before a
closing quote) is decoded only on a line where as many others are. A second step handles bytes of one single-byte code page
read as another one. It needs evidence: a sign or a capital inside a word in small letters, or a letter of another script in
a Latin word. What stands nowhere else in the corpus's languages is no evidence by itself, so mathematics, units, other
languages, ligatures and boxes stay. The replacement character marks a row as damaged, but what it replaced is lost.

Defined results: null, empty and pure ASCII texts are never damaged; a text is judged by itself, so repeated rows get
equal results; extra columns pass through restored() untouched. Whole texts are examined, of any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import lexicons

# Code pages in which UTF-8 bytes are misread, the likeliest first.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "iso8859-15")
# Code pages as which Windows-1252 bytes are misread.
SINGLE = ("mac_roman", "cp1251", "cp437", "cp850")


def _page(name: str) -> dict[str, int]:
    """Character to byte for the upper half of a code page; bytes without a character keep their C1 control."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if name in ("cp1252", "cp1251", "cp1250") else {}
    for b in range(0x80, 0x100):
        c = bytes([b]).decode(name, "ignore")
        if c:
            out[c] = b
    return out


_BYTE = {name: _page(name) for name in PAGES}
_RUN = {name: regex.compile("[" + regex.escape("".join(m), special_only=False) + "]{2,}") for name, m in _BYTE.items()}

#: What decoding may yield: C1 controls (damaged twice), Latin letters with marks, Latin-1 signs, typographic marks, currency signs, Cyrillic, emoji.
_PLAUSIBLE = regex.compile(
    "[\\u0080-\\u017f\\u02c6\\u02dc\\u0391-\\u03c9\\u0400-\\u045f\\u0490\\u0491\\u0501\\u1d0f\\u1e00-\\u1eff\\u200b-\\u200f\\u2010-\\u2027\\u202f\\u2030-\\u203a\\u20ac\\u2116\\u2122\\u2190-\\u21ff\\u2600-\\u27bf\\ufe0f\\ufeff\\ufffd\\U0001f300-\\U0001faff]+"
)
_LETTER = regex.compile(r"\p{L}")


def _spans(data: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of well-formed multibyte sequences: an automaton over lead and continuation bytes."""
    i, n, start = 0, len(data), -1
    while i < n:
        b = data[i]
        more = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
        whole = more and i + more < n and low <= data[i + 1] <= high and all(0x80 <= x <= 0xBF for x in data[i + 2 : i + 1 + more])
        if whole:
            start = i if start < 0 else start
            i += 1 + more
            continue
        if start >= 0:
            yield start, i
            start = -1
        i += 1
    if start >= 0:
        yield start, n


def _word_at(text: str, a: int, b: int) -> str:
    while a and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha():
        b += 1
    return text[a:b]


def _natural(text: str, a: int, b: int, made: str) -> bool:
    """Whether text[a:b], one sequence for the character `made`, may stand like this in a text that nothing happened to."""
    own, before, after = text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]
    if all(_SCRIPT.match(c) for c in own):  # a word of one other script in usual case, or look-alikes that begin a Latin word
        word = _word_at(text, a, b)
        return not after.isdigit() and not _LATIN.search(word) and (word.islower() or word.isupper() or word.istitle()) or own[0] == "Р" and own[1:] in ("і", "ѕ") and not before.isalpha()
    if all("\u2500" <= c <= "\u25ff" for c in own):  # lines and boxes
        return not ("\u0410" <= made <= "\u045f" or before.isalpha() and before.isascii() or after.islower() and not "\u2500" <= before <= "\u25ff")
    if len(own) == 2 and own[0] in _OPENERS:
        return after.islower() and (own[1].isupper() or not before.isalpha())
    return len(own) == 2 and own[0].isupper() and own[0] not in "ÃÂ" and own[1] in _CLOSERS and not after.isalpha() and not before.islower()


def _rare(c: str) -> bool:
    """Assigned characters that only their context tells from chance sequences."""
    return not _PLAUSIBLE.match(c) and unicodedata.category(c) not in ("Cn", "Co", "Cs")


def _meant(c: str, text: str, a: int, b: int, several: bool) -> bool:
    """Whether text[a:b] stands for the rare character c: not for a letter that quotes or other signs follow by chance."""
    if several:
        return True
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    if b - a == 2:
        return bool(_LATIN.match(c)) and (before.islower() or after.islower())
    return not all(x in _SIGNS for x in text[a + 1 : b]) or "\u2000" <= c < "\u2c00" and not before.isalpha()


def _decoded(text: str, page: str) -> str:
    """The text with all well-formed sequences of one code page decoded, each judged by itself."""
    table, found = _BYTE[page], []
    for m in _RUN[page].finditer(text):
        data = bytes(table[c] for c in m.group())
        for a, b in _spans(data):
            made = data[a:b].decode("utf-8")
            rare = [_rare(c) for c in made]
            several = sum(rare) > 1
            start = m.start() + a
            for c, odd in zip(made, rare):
                end = start + len(c.encode("utf-8"))
                if _PLAUSIBLE.match(c) or odd and _meant(c, text, start, end, several):
                    found.append((start, end, c, _natural(text, start, end, c)))
                start = end
    weak, strong = Counter(), Counter()  # by line: what might be genuine is decoded only among as much that is not
    line = lambda at: text.count("\n", 0, at)
    for start, _, _, natural in found:
        (weak if natural else strong)[line(start)] += 1
    parts, last = [], 0
    for start, end, c, natural in found:
        if not natural or strong[line(start)] and strong[line(start)] >= weak[line(start)]:
            parts += [text[last:start], c]
            last = end
    return "".join(parts) + text[last:] if parts else text


def _multibyte(text: str) -> str:
    """One round of decoding by the code page that leaves the fewest characters out of place."""
    found = [(_badness(made), i, made) for i, page in enumerate(PAGES) if (made := _decoded(text, page)) != text]
    return min(found)[2] if found else text


# Letters of the corpus's languages and of names in them; signs that stand in ordinary text.
_LETTERS = "éèêëàâäáãåæçñóôöøœúùûüíîïßłćńśźżžščđ"
_UPPER = _LETTERS.replace("ß", "").upper()
_LETTERS += _UPPER
_SIGNS = "“”„‘’‚«»–—…•€£¥¢©®™°§ºª¿¡½¼¾×·¹²³±µ\u00a0\u202f\u2009\ufe0f"
_ALONE = "àÀéÉáÁóÓèÈ"
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPT = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_LATIN = regex.compile(r"\p{Latin}")
_HIGH = re.compile(r"[^\x00-\x7f]")
_INVISIBLE = set(lexicons.INVISIBLE)


def _plain(c: str) -> bool:
    return c in _SIGNS or c in _INVISIBLE or ord(c) > 0x2190 and unicodedata.category(c) in ("So", "Sk", "Cf", "Mn")


def _badness(text: str) -> int:
    """How many characters stand where no ordinary text has them."""
    bad = 0
    for m in _HIGH.finditer(text):
        c, i = m.group(), m.start()
        if c == "\ufffd" or _plain(c) and not "\u2190" < c < "\u2600":
            continue
        before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        if _SCRIPT.match(c):
            a, b = i, i + 1
            while a and text[a - 1].isalpha():
                a -= 1
            while b < len(text) and text[b].isalpha():
                b += 1
            word = text[a:b]
            bad += (len(word) == 1 or bool(_LATIN.search(word))) and c not in lexicons.LOOKALIKE_FROM
        elif c in _LETTERS:
            near = before.isalpha() or after.isalpha() or before in _INVISIBLE or after in _INVISIBLE
            bad += c.isupper() and (before.islower() or before.isalpha() and after.islower()) or after.isdigit() or not near and after not in ("-", ".", "\u2019", "'") and c not in _ALONE
        else:
            bad += 1
    return bad


# -- bytes of one single-byte page read as another -------------------------------------------------------------------

#: Marks that open or close a quotation or stand between words; they are no part of a word.
_OPENERS, _CLOSERS = "«»“”‘’‚„‹›–—…", "”“’‘»«›‹…™®)"
_OUTSIDE = set(_OPENERS + _CLOSERS + "'’-‐‑\u00ad\u200b\u200c\u200d\ufeff")
_RIGHT = {page: {c: bytes([b]).decode("cp1252", "replace") for c, b in _page(page).items()} for page in SINGLE}
_SEEN = set(_LETTERS + _SIGNS)


def _evidence(text: str) -> list[int]:
    """Places of characters that no writing has there.

    These are signs and capitals inside words in small letters, letters of another script in Latin words, and letters that
    stand for an amount's currency or open a quotation on some page.
    """
    out = []
    for m in _HIGH.finditer(text):
        c, i = m.group(), m.start()
        before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        if not before.isalnum() and c.isalpha() and (after.isdigit() and text[i + 2 : i + 3] in _FIGURES and any(r.get(c) in ("€", "£") for r in _RIGHT.values()) or c == "ì" and after.isalpha()):
            out.append(i)
        if c in _OUTSIDE or "\ufb00" <= c <= "\ufb06" or not (before.isalpha() or after.isalpha()):
            continue
        if _SCRIPT.match(c):
            word = _word_at(text, i, i + 1)
            latin = sum(x.isascii() for x in word)
            if c not in lexicons.LOOKALIKE_FROM and len(word) > 2 and (latin if "\u0400" <= c else latin > 2):
                out.append(i)
        elif unicodedata.category(c) == "Lu":
            title = before.isupper() and before.isascii() and not text[i - 2 : i - 1].isalpha() and text[i + 1 : i + 3].islower() and text[i + 1 : i + 3].isalpha()
            if title or before.islower() and before.isalpha() and (after.islower() or not after.isalpha()):
                out.append(i)
        elif unicodedata.category(c) != "Ll" and before.isalpha() and after.islower() and after.isalpha() and not (c == "·" and before == after == "l"):
            left, right = len(_TAIL.search(text, max(0, i - 4), i).group()), len(_HEAD.match(text, i + 1, i + 5).group())
            short = text[i - left : i].lower(), text[i + 1 : i + 1 + right]
            if left + right > 3 if c in _MATHS else left + right > 2 or any(f"{short[0]}{r.get(c)}{short[1]}" in _SHORT for r in _RIGHT.values()):
                out.append(i)
    return out


_FIGURES = tuple("0123456789.,")
_TAIL, _HEAD = regex.compile(r"\p{L}*$"), regex.compile(r"\p{L}*")
#: Signs that also stand between the letters of a formula.
_MATHS = set("²³¹±×÷·°≤≥≠≈∞√∂∫∑∏−⋅∙")
# Short words in which the letter with a mark is often damaged.
_SHORT = {"für", "sûr", "mûr", "tôt", "tür", "grün", "süd", "nür", "día", "año", "más"}


def _explained(text: str, places: list[int], page: str) -> int:
    """How many of the places hold what this page shows for a letter with a mark, a currency sign or an opening quotation mark."""
    made = [(text[i], _RIGHT[page].get(text[i], "")) for i in places]
    return sum(r in _SEEN and (r.isalpha() and (r.islower() or c.isupper() and _SCRIPT.match(c) is not None) or r in "€£“") for c, r in made if r)


def _read_as(text: str, page: str) -> str | None:
    """The text with all bytes read again, if that leaves only what the corpus's languages write."""
    if any(c not in _RIGHT[page] and c not in _INVISIBLE for c in _HIGH.findall(text)):
        return None
    made = _HIGH.sub(lambda m: _RIGHT[page].get(m.group(), m.group()), text)
    return made if all(c in _SEEN or c in _INVISIBLE for c in _HIGH.findall(made)) and not _evidence(made) else None


def _single(text: str, depth: int = 0) -> str:
    """Bytes read again by the page that explains all evidence of damage: the whole text, else line by line, else word by word."""
    places = _evidence(text)
    if not places:
        return text
    for page in sorted(SINGLE, key=lambda p: -_explained(text, places, p)):
        if _explained(text, places, page) == len(places) and (made := _read_as(text, page)) is not None:
            return made
    if depth == 2:
        return text
    return "".join(_single(x, depth + 1) for x in regex.split(r"(\n)" if depth == 0 else r"(\s)", text))


def _class(chars: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


_SEQUENCE = re.compile("|".join(_class({c for c, b in m.items() if 0xC2 <= b <= 0xF4}) + _class({c for c, b in m.items() if 0x80 <= b <= 0xBF}) for m in _BYTE.values()))
_ODD = regex.compile(r"[\ufffd\x80-\x9f]|[\p{L}--\p{ASCII}][0-9]|(?<!\p{L})ì|(?<=\p{L})[^\x00-\x7f\p{Ll}](?=\p{Ll}|\P{L}|$)|(?<=\p{L})[^\x00-\x7f\p{L}]|(?<=[A-Za-z])[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}](?=[A-Za-z])", regex.V1)


def repair(text: str | None) -> tuple[str | None, bool]:
    """The restored text and whether the text was damaged."""
    if not text or not _HIGH.search(text) or not (_ODD.search(text) or _SEQUENCE.search(text)):
        return text, False
    now = text
    for _ in range(8):  # two layers of damage, each perhaps by several code pages
        made = _multibyte(now)
        if made == now:
            break
        now = made
    # rare characters that decoding gave are right as they are; a single-byte page must not explain them away
    kept = {c for c in set(now) - set(text) if c > "\x7f" and _rare(c)}
    made = [c for c in now if c in kept]
    if made and "\0" not in now:
        back = iter(made)
        now = re.sub("\0", lambda m: next(back), _single("".join("\0" if c in kept else c for c in now)))
    elif not made:
        now = _single(now)
    return now, now != text or "\ufffd" in text or any("\x80" <= c <= "\x9f" for c in text)


def _suspect(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def restored(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with a damaged text, their columns and `restored`, the repaired text. Pure ASCII texts never leave the JVM."""

    @F.pandas_udf("struct<restored string, damaged boolean>")
    def fix(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t) for t in texts], columns=["restored", "damaged"])

    rows = df.where(_suspect(F.col(text_col))).withColumn("__fix", fix(F.col(text_col)))
    return rows.where("__fix.damaged").withColumn("restored", F.col("__fix.restored")).drop("__fix")
