"""The 95 style features (F1-F95) as column expressions.

Words and sentences are materialised once per text; all word statistics come out of one pass over the sorted words, all
function-word counts out of the words that are function words. There is no shuffle: features are a projection.
Null texts count as empty, and every feature of an empty text is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import text as X

# Names and order of the features.
SCALARS = (
    "char_count word_count sentence_count avg_word_length std_word_length avg_sentence_length std_sentence_length "
    "type_token_ratio hapax_ratio dis_legomena_ratio honore_r yule_k flesch_reading_ease flesch_kincaid_grade avg_syllables_per_word "
    "comma_ratio period_ratio exclamation_ratio question_ratio punctuation_ratio uppercase_ratio digit_ratio url_count email_addr_count urgency_word_ratio"
).split()
FUNCTION_WORD_FEATURES = [f"fw_{w}" for w in lexicons.FUNCTION_WORDS]
FEATURE_NAMES = SCALARS + FUNCTION_WORD_FEATURES
# The features whose class means are reported.
FOCUS = (
    "exclamation_ratio email_addr_count uppercase_ratio avg_word_length period_ratio digit_ratio url_count urgency_word_ratio word_count "
    "std_sentence_length type_token_ratio flesch_reading_ease flesch_kincaid_grade fw_the fw_do comma_ratio"
).split()
# Superscript, subscript and circled digits, which count as digits besides decimal digits.
_OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
_CONSONANTS = "bcdfghjklmnpqrstvwxz'"
#: An address can begin only at the end of the last one or at the first of the characters that its name may hold; looked for nowhere else.
_EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+-])){lexicons.EMAIL}"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def syllables(low: Column) -> Column:
    """Vowel groups of all words of a lower-case text: one less for words of several groups that end in e, one for words without any."""
    silent = f"(?<![a-z'])(?=[a-z']++(?<=e))[a-z']*[aeiouy][{_CONSONANTS}][a-z']*e(?![a-z'])"
    mute = f"(?<![a-z'])[{_CONSONANTS}]+(?![a-z'])"
    return _count(low, "[aeiouy]+") - _count(low, silent) + _count(low, mute)


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the integer counts that all features are made of, in columns whose names begin with `__c_`."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(t)
    wide = F.regexp_replace(t, r"[\x00-\x7f]+", "")  # few texts have many such characters; classes beyond ASCII are slow to test
    out = df.withColumn("__c_words", F.sort_array(X.words(t)))
    start = F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in (("last", "", "string"), ("run", 0, "long"), ("v", 0, "long"), ("twice", 0, "long"), ("thrice", 0, "long"), ("sq", 0, "long"), ("len", 0, "long"), ("len2", 0, "long"))])

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["last"], a["run"] + 1).otherwise(F.lit(1).cast("long"))
        size = F.length(w).cast("long")
        hit = lambda k: (run == k).cast("long")
        return F.struct(
            w.alias("last"), run.alias("run"), (a["v"] + hit(1)).alias("v"), (a["twice"] + hit(2)).alias("twice"), (a["thrice"] + hit(3)).alias("thrice"),
            (a["sq"] + 2 * run - 1).alias("sq"), (a["len"] + size).alias("len"), (a["len2"] + size * size).alias("len2"),
        )

    out = out.withColumn("__c_stats", F.aggregate("__c_words", start, step))
    lengths = F.transform(X.sentences(t), lambda s: _count(F.lower(s), lexicons.WORD))
    out = out.withColumn("__c_sentences", lengths).withColumn("__c_lexical", F.filter("__c_words", lambda w: w.isin(lexicons.FUNCTION_WORDS)))
    counts = {
        "chars": F.length(t).cast("long"), "n": F.size("__c_words").cast("long"), "s": F.size("__c_sentences").cast("long"),
        "sent": F.aggregate("__c_sentences", F.lit(0).cast("long"), lambda a, x: a + x), "sent2": F.aggregate("__c_sentences", F.lit(0).cast("long"), lambda a, x: a + x * x),
        "v": F.col("__c_stats.v"), "hapax": F.col("__c_stats.v") - F.col("__c_stats.twice"), "dis": F.col("__c_stats.twice") - F.col("__c_stats.thrice"), "sq": F.col("__c_stats.sq"),
        "len": F.col("__c_stats.len"), "len2": F.col("__c_stats.len2"), "syllables": syllables(low),
        "comma": _count(t, ","), "period": _count(t, "[.]"), "exclamation": _count(t, "!"), "question": _count(t, "[?]"), "punctuation": _count(t, "[,.;:!?'\"()-]"),
        "upper": _count(t, r"\p{IsUppercase}"), "digit": _count(t, "[0-9]") + _count(wide, rf"[\p{{Nd}}{_OTHER_DIGITS}]"), "url": _count(t, lexicons.URL), "email": F.when(F.contains(t, F.lit("@")), _count(t, _EMAIL)).otherwise(F.lit(0).cast("long")),
        "urgent": F.size(F.filter("__c_words", lambda w: w.isin(lexicons.URGENCY_WORDS))).cast("long"),
    }
    # one expression for all function words: a projection of 70 would be too large for compiled code
    held = F.size("__c_lexical")
    counts["lexicon"] = F.transform(F.array(*[F.lit(w) for w in lexicons.FUNCTION_WORDS]), lambda w: held - F.size(F.array_remove("__c_lexical", w)))
    return out.withColumns({f"__c_{k}": v for k, v in counts.items()}).drop("__c_stats", "__c_sentences", "__c_lexical")


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from integer sums."""
    return F.coalesce(F.sqrt(F.try_divide((n * squares - total * total).cast("double"), (n * n).cast("double"))), F.lit(0.0))


def expressions() -> dict[str, Column]:
    """Every feature by name, over the columns of counted()."""
    c = lambda name: F.col(f"__c_{name}")
    n, chars, asl, asw = c("n"), c("chars"), _ratio(c("n"), c("s")), _ratio(c("syllables"), c("n"))
    by_chars = {f"{k}_ratio": _ratio(c(v), chars) for k, v in (("comma", "comma"), ("period", "period"), ("exclamation", "exclamation"), ("question", "question"), ("punctuation", "punctuation"), ("uppercase", "upper"), ("digit", "digit"))}
    honore = F.when((n > 1) & (c("v") > 0) & (c("hapax") != c("v")), 100 * F.ln(n.cast("double")) / (1 - c("hapax").cast("double") / c("v").cast("double"))).otherwise(0.0)
    out = {
        "char_count": chars.cast("double"), "word_count": n.cast("double"), "sentence_count": c("s").cast("double"),
        "avg_word_length": _ratio(c("len"), n), "std_word_length": _deviation(n, c("len"), c("len2")),
        "avg_sentence_length": _ratio(c("sent"), c("s")), "std_sentence_length": _deviation(c("s"), c("sent"), c("sent2")),
        "type_token_ratio": _ratio(c("v"), n), "hapax_ratio": _ratio(c("hapax"), n), "dis_legomena_ratio": _ratio(c("dis"), n),
        "honore_r": honore, "yule_k": F.coalesce(1e4 * F.try_divide((c("sq") - c("v")).cast("double"), (n * n).cast("double")), F.lit(0.0)),
        "flesch_reading_ease": F.when(n > 0, 206.835 - 1.015 * asl - 84.6 * asw).otherwise(0.0),
        "flesch_kincaid_grade": F.when(n > 0, 0.39 * asl + 11.8 * asw - 15.59).otherwise(0.0), "avg_syllables_per_word": asw,
    } | by_chars | {"url_count": c("url").cast("double"), "email_addr_count": c("email").cast("double"), "urgency_word_ratio": _ratio(c("urgent"), n)}
    for i, word in enumerate(lexicons.FUNCTION_WORDS):
        out[f"fw_{word}"] = _ratio(c("lexicon")[i], n)
    return {k: out[k] for k in FEATURE_NAMES}


def features(df: DataFrame, text_col: str = "text", names: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """df with the named features as DOUBLE columns, all 95 by default, optionally rounded; a column of a feature's name is replaced."""
    made = expressions()
    kept = {k: made[k] if digits is None else F.round(made[k], digits) for k in (names or FEATURE_NAMES)}
    return counted(df, text_col).withColumns(kept).select(*[c for c in df.columns if c not in kept], *kept)
