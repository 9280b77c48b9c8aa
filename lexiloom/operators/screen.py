"""Length, language and credential screens and the funnel of a corpus.

The reason column names the first rule a row fails: internal, length, language, screen, or kept. Cheap rules come first, and
CASE evaluates them in order. A null text fails the length rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import text as X

REASONS = ("internal", "length", "language", "screen", "kept")


def _any(terms: list[str]) -> str:
    """One alternation of literal terms; a regular expression compiles it once per task."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in terms)


def length_ok(text: Column) -> Column:
    return F.coalesce(F.length(text).between(lexicons.MIN_CHARS, lexicons.MAX_CHARS), F.lit(False))


def stopword_share(text: Column) -> tuple[Column, Column]:
    """Number of words and of stop words."""
    words = _latin_words(text)
    return F.size(words), F.size(F.filter(words, lambda w: w.isin(lexicons.STOPWORDS)))


def _latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def looks_english(text: Column) -> Column:
    """At least 20 words, of which at least 0.12 are stop words; false for a null text."""
    share = lambda w: F.try_divide(F.size(F.filter(w, lambda x: x.isin(lexicons.STOPWORDS))).cast("double"), F.size(w).cast("double"))
    return F.coalesce(X.let(_latin_words(text), lambda w: (F.size(w) >= lexicons.MIN_WORDS) & (share(w) >= lexicons.STOPWORD_SHARE)), F.lit(False))


def arms(text: Column, subject: list[str] = lexicons.ACCOUNT_TERMS, action: list[str] = lexicons.ACTION_TERMS, call: list[str] = lexicons.CTA_TERMS) -> dict[str, Column]:
    """The four tests of the screen on the match form; each is false for a null text."""
    m = X.match_form(text)
    tests = {"has_subject": _any(subject), "has_action": _any(action), "has_call": _any(call), "has_url": lexicons.URL_HINT}
    return {k: F.coalesce(m.rlike(v), F.lit(False)) for k, v in tests.items()}


def credential_screen(text: Column, subject: list[str] = lexicons.ACCOUNT_TERMS, action: list[str] = lexicons.ACTION_TERMS, call: list[str] = lexicons.CTA_TERMS) -> Column:
    """Subject and (action or call to action or link), in that order; false for a null text."""
    solicits = "|".join([_any(action), _any(call), lexicons.URL_HINT])
    return F.coalesce(X.let(X.match_form(text), lambda m: m.rlike(_any(subject)) & m.rlike(solicits)), F.lit(False))


def reason(text: Column, needs_english: Column, internal: Column | None = None) -> Column:
    """First failed rule; the language rule applies where needs_english holds."""
    inside = F.coalesce(internal, F.lit(False)) if internal is not None else F.lit(False)
    english = F.coalesce(needs_english, F.lit(False))

    def first_failed(t: Column) -> Column:
        return F.when(inside, "internal").when(~length_ok(t), "length").when(english & ~looks_english(t), "language").when(~credential_screen(t), "screen").otherwise("kept")

    return X.let(text, first_failed)


def funnel(df: DataFrame, groups: list[str], reason_col: str = "reason", rollup: bool = False) -> DataFrame:
    """Counts per group: messages, one column for each reason to exclude, kept. With rollup also per prefix of the groups and in total."""
    grouped = df.rollup(*groups) if rollup else df.groupBy(*groups)
    return grouped.agg(F.count("*").alias("messages"), *[F.count_if(F.col(reason_col) == r).alias(r if r == "kept" else f"excluded_{r}") for r in REASONS])
