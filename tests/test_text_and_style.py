import math
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import pieces, style
from lexiloom.functions import text as X
from lexiloom.operators import screen

GOLDEN_TEXTS = ["", "the the the the", "The cat sat. The cat ran! Don't the dogs?", "Please verify at http://bad.example/login or email a@b.com now", "one two three", "Étude ²3 Ω."]
GOLDEN = {
    "char_count": [0, 15, 41, 62, 13, 11], "word_count": [0, 4, 9, 13, 3, 1], "sentence_count": [0, 1, 3, 3, 1, 1],
    "avg_word_length": [0, 3, 3.333333, 3.692308, 3.666667, 4], "std_word_length": [0, 0, 0.666667, 1.896743, 0.942809, 0],
    "avg_sentence_length": [0, 4, 3, 4.333333, 3, 1], "std_sentence_length": [0, 0, 0, 1.699673, 0, 0], "type_token_ratio": [0, 0.25, 0.666667, 1, 1, 1],
    "hapax_ratio": [0, 0, 0.444444, 1, 1, 1], "dis_legomena_ratio": [0, 0, 0.111111, 0, 0, 0], "honore_r": [0, 138.629436, 659.167373, 0, 0, 0], "yule_k": [0, 9375, 1358.024691, 0, 0, 0],
    "flesch_reading_ease": [0, 118.175, 119.19, 85.298205, 119.19, 121.22], "flesch_kincaid_grade": [0, -2.23, -2.62, 2.438462, -2.62, -3.4],
    "url_count": [0, 0, 0, 1, 0, 0], "email_addr_count": [0, 0, 0, 1, 0, 0],
}


def plain_counts(t):
    """Counts of a text in plain Python, for comparison."""
    words = re.findall("[A-Za-z']+", t.lower())
    groups = [len(re.findall("[aeiouy]+", w)) for w in words]
    return len(words), sum(max(1, g - (w.endswith("e") and g > 1)) for w, g in zip(words, groups)), len({w for w in words if words.count(w) == 1})


def test_feature_names_are_stable():
    assert len(style.FEATURE_NAMES) == 95 and style.FEATURE_NAMES[0] == "char_count" and style.FEATURE_NAMES[25] == "fw_the" and style.FEATURE_NAMES[-1] == "fw_kindly"
    assert len(lexicons.FUNCTION_WORDS) == 70 and len(lexicons.URGENCY_WORDS) == 20 and len(lexicons.STOPWORDS) == 28
    assert (len(lexicons.ACCOUNT_TERMS), len(lexicons.ACTION_TERMS), len(lexicons.CTA_TERMS)) == (33, 20, 26) and len(lexicons.LOOKALIKE_FROM) == len(lexicons.LOOKALIKE_TO) == 28


def test_goldens(spark):
    df = spark.createDataFrame(list(enumerate(GOLDEN_TEXTS)), "id int, text string")
    got = style.features(df).orderBy("id").collect()
    for name, wanted in GOLDEN.items():
        assert [r[name] for r in got] == pytest.approx(wanted, abs=1e-6), name
    assert got[5]["digit_ratio"] == pytest.approx(2 / 11) and got[5]["uppercase_ratio"] == pytest.approx(2 / 11)
    assert all(math.isfinite(v) for r in got for v in r[2:])


def test_features_of_null_empty_clashing_and_long(spark):
    long = "The account expires now. " * 40000
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, long, 9.0)], "id int, text string, word_count double")
    got = {r["id"]: r for r in style.features(df, names=["word_count", "fw_the", "urgency_word_ratio"]).collect()}
    assert got[1]["word_count"] == got[2]["word_count"] == 0 and got[3]["word_count"] == 160000 and got[3]["fw_the"] == 0.25 and got[3]["urgency_word_ratio"] == 0.5
    assert style.features(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aeibcdy' .!?A\né-", max_size=60), min_size=1, max_size=5))
def test_counts_against_plain_python(spark, texts):
    got = style.counted(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)).select("id", "__c_n", "__c_syllables", "__c_hapax").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: plain_counts(t) for i, t in enumerate(texts)}


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "form, text, wanted",
    [
        (X.loader_form, "  Hello\tWORLD \n x ", "hello world x"),
        (X.alnum_key, "A-b  C! é 9", "abc9"),
        (X.stored_form, "a  b  c​ \n\n\n\n d ", "a b c\n\nd"),
        (X.stored_form, "x \r\n yﬁ", "x\nyfi"),
        (X.html_to_text, "<style>q</style>A<br/>B&amp;C", " A\nB&C"),
        (X.match_form, "pаss­WORD", "password"),
        (X.drop_header_line, "HEADER: a\r\nbody\n", "body"),
        (X.drop_header_line, "body\nheader: x", "body\nheader: x"),
        (X.number, "1,234.50 and 7", 1234.5),
        (X.number, "none", None),
        (X.title_form, "A – B\t c", "a - b c"),
        (X.snippet, "a\nb" + "c" * 500, "a b" + "c" * 417),
    ],
)
def test_forms(spark, form, text, wanted):
    assert one(spark, text, form) == wanted
    assert one(spark, None, form) is None


@pytest.mark.parametrize("text, wanted", [("abcdef", ["abcde", "bcdef"]), ("abc", ["abc"]), ("", []), ("!!", [])])
def test_shingles(spark, text, wanted):
    assert one(spark, text, X.shingles) == wanted


def test_jaccard(spark):
    df = spark.createDataFrame([("abcdef", "abcdefg"), ("abcdef", "abcdex"), ("", "")], "x string, y string")
    assert [r[0] for r in df.select(X.jaccard(X.shingles(F.col("x")), X.shingles(F.col("y")))).collect()] == pytest.approx([2 / 3, 1 / 3, 0])
    import pyarrow as pa

    assert pieces.jaccard(pa.array(["abcdef", "abcdef", "", "ab", None]), pa.array(["abcdefg", "abcdex", "", "A-b", "x"])).tolist() == pytest.approx([2 / 3, 1 / 3, 0, 1, 0])


@pytest.mark.parametrize(
    "text, wanted",
    [("the account", False), ("please visit", False), ("invoice, please visit", True), ("identity at www.x", True), ("verified", True), ("pаssword: cl­ick", True), (None, False), ("", False)],
)
def test_screen(spark, text, wanted):
    assert one(spark, text, screen.credential_screen) is wanted


@pytest.mark.parametrize("words, wanted", [(["the"] * 19, False), (["the"] * 3 + ["x"] * 22, True), (["the"] * 2 + ["x"] * 23, False)])
def test_english(spark, words, wanted):
    assert one(spark, " ".join(words), screen.looks_english) is wanted


@pytest.mark.parametrize("n, wanted", [(149, False), (150, True), (8000, True), (8001, False)])
def test_length(spark, n, wanted):
    assert one(spark, "é" * n, screen.length_ok) is wanted


def test_stored_form_against_unicodedata(spark):
    text = "ＡＢＣ ﬁ ① ½"
    assert one(spark, text, X.stored_form) == unicodedata.normalize("NFKC", text)


def test_funnel_counts_first_failure(spark):
    long = "please click the account link " * 10
    df = spark.createDataFrame([("a", 0, "short"), ("a", 0, long), ("a", 1, "x" * 200), ("b", 0, "x " * 200), ("b", 0, None)], "source string, label int, text string")
    rows = df.withColumn("reason", screen.reason(F.col("text"), F.col("label") == 0))
    got = {r["source"]: r.asDict() for r in screen.funnel(rows, ["source"]).collect()}
    assert got["a"] == dict(source="a", messages=3, excluded_internal=0, excluded_length=1, excluded_language=0, excluded_screen=1, kept=1)
    assert (got["b"]["excluded_length"], got["b"]["excluded_language"]) == (1, 1)
