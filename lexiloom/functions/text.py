"""Normal forms and keys of texts as column expressions.

A null text stays null in every form. The two steps that Spark has no built-in for, compatibility composition and HTML
entities, run as Arrow-batched pandas UDFs on the texts that need them only.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom import lexicons

_INVISIBLE = f"[{lexicons.INVISIBLE}]"
# White space as a class that Java's and RE2's regular expressions read alike.
SPACE = "\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def loader_form(text: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(text)), f"[{SPACE}]+", " ")


def alnum_key(text: Column) -> Column:
    """Lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def stored_form(text: Column) -> Column:
    """NFKC, no invisible characters, single spaces, stripped lines, at most one empty line, stripped."""
    t = F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text)
    t = F.translate(F.regexp_replace(t, _INVISIBLE, ""), " ", " ")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    inline = SPACE.replace("\\n", "")
    t = F.regexp_replace(t, f"(?md)^[{inline}]+|[{inline}]+$", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def match_form(text: Column) -> Column:
    """No invisible characters, look-alike letters folded, then lower case (N4); texts without either skip the folding."""
    folded = F.translate(F.regexp_replace(text, _INVISIBLE, ""), lexicons.LOOKALIKE_FROM, lexicons.LOOKALIKE_TO)
    return F.lower(F.when(text.rlike(lexicons.FOLD_HINT), folded).otherwise(text))


def html_to_text(markup: Column, unescape: bool = True) -> Column:
    """Script and style blocks and tags as spaces, line-ending tags as line feeds, entities unescaped."""
    t = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</div>|</tr>|</li>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    return F.when(t.contains("&"), _unescape(t)).otherwise(t) if unescape else t


def drop_header_line(raw: Column) -> Column:
    """Without a first line that starts with `header:` in any case; all line ends become line feeds."""
    lines = F.regexp_replace(raw, r"\r\n|[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n\z", ""), r"(?i)\Aheader:[^\n]*(?:\n|\z)", "")


def loader_digest(text: Column) -> Column:
    return F.sha1(loader_form(text))


def key_digest(text: Column) -> Column:
    return F.sha1(alnum_key(text))


def snippet(text: Column, size: int = lexicons.SNIPPET) -> Column:
    """The first characters on one line."""
    return F.translate(F.substring(text, 1, size), "\n", " ")


def number(text: Column) -> Column:
    """The first number of a text, thousands commas removed; null if there is none."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?\d+\.\d+|-?\d+)", 1).try_cast("double")


def title_form(title: Column) -> Column:
    """Dashes alike, white space collapsed, lower case."""
    dashes = "‐‑‒–—−"
    return F.lower(strip(F.regexp_replace(F.translate(title, dashes, "-" * len(dashes)), f"[{SPACE}]+", " ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(lexicons.WORD), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, lexicons.SENTENCE_END), lambda s: s.rlike(f"[^{SPACE}]"))


def shingles(text: Column, k: int = lexicons.SHINGLE) -> Column:
    """Distinct k-character pieces of the key; a shorter key is its own piece, an empty one has none."""
    key = alnum_key(text)
    pieces = F.array_distinct(F.regexp_extract_all(key, F.lit(f"(?=(.{{{k}}}))"), F.lit(1)))
    return F.when(F.length(key) >= k, pieces).when(F.length(key) > 0, F.array(key)).otherwise(F.array().cast("array<string>"))


def jaccard(x: Column, y: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(x) + F.size(y) - shared), F.lit(0.0))
