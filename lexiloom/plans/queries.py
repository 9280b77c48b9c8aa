"""Registered queries: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import style
from lexiloom.functions import text as X
from lexiloom.operators import audit, dedupe, metrics, ranking, screen, similarity
from lexiloom.runtime import cut, spread, table
from lexiloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from lexiloom.plans import model_queries  # registers its queries  # noqa: F401

    return dict(_REGISTRY)


def _emails(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Emails with a text."""
    return spread(table(spark, sf_dir, "emails").where("text is not null").select("email_id", "text", *columns))


def _style(df: DataFrame, *names: str, digits: int | None = 6) -> DataFrame:
    return style.features(df, names=list(names), digits=digits)


# -- style features --------------------------------------------------------------------------------------------------


@query
def readability_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F3, F13-F15 averaged per source; sums of counts are integers, so the averages do not depend on the order of addition."""
    rows = style.counted(_emails(spark, sf_dir, "source"))
    mean = lambda c: F.round(F.try_divide(F.sum(c).cast("double"), F.count("*")), 6)
    return rows.groupBy("source").agg(F.count("*").alias("n"), mean("__c_chars").alias("avg_chars"), mean("__c_n").alias("avg_words"), mean("__c_s").alias("avg_sentences"), F.sum("__c_syllables").alias("syllables"))


@query
def readability_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = style.counted(spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "text")))
    total = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("__c_n").alias("words"), F.sum("__c_s").alias("sentences"), F.sum("__c_syllables").alias("syllables"))
    asl, asw = (F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("words", "sentences"), ("syllables", "words")))
    return total.withColumn("flesch", F.round(206.835 - 1.015 * asl - 84.6 * asw, 6))


@query
def doc_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), *style.SCALARS[:7]).drop("text")


@query
def vocab_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), *style.SCALARS[7:10]).drop("text")


@query
def honore_yule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), "honore_r", "yule_k").drop("text")


@query
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), *style.SCALARS[12:15]).drop("text")


@query
def punct_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), *style.SCALARS[15:20]).drop("text")


@query
def orthography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), "uppercase_ratio", "digit_ratio").drop("text")


@query
def structural_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(_emails(spark, sf_dir), "url_count", "email_addr_count", "urgency_word_ratio").drop("text")


@query
def function_words_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each function word by class, counted before the shuffle."""
    rows = _emails(spark, sf_dir, "label").select("label", F.explode(X.words(F.col("text"))).alias("word"))
    return rows.where(F.col("word").isin(lexicons.FUNCTION_WORDS)).groupBy("label", "word").agg(F.count("*").alias("n"))


@query
def feature_vector_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.features(_emails(spark, sf_dir), digits=6).drop("text")


@query
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the 16 focus features by class, features as rows; each value is rounded so that sums are stable to 4 digits."""
    return _class_means(_style(_emails(spark, sf_dir, "label").where("label in (0, 1)"), *style.FOCUS).drop("text"))


def _class_means(rows: DataFrame) -> DataFrame:
    long = rows.select("label", *style.FOCUS).unpivot(["label"], style.FOCUS, "feature", "value")
    mean = lambda v: F.round(F.avg(F.when(F.col("label") == v, F.col("value"))), 4)
    return long.groupBy("feature").agg(mean(0).alias("class_0"), mean(1).alias("class_1"))


# -- normal forms ----------------------------------------------------------------------------------------------------


@query
def loader_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the whole loader form."""
    rows = _emails(spark, sf_dir)
    return rows.select("email_id", F.sha1(X.loader_form(F.col("text"))).alias("digest"))


@query
def alnum_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emails(spark, sf_dir)
    return rows.select("email_id", F.length(X.alnum_key(F.col("text"))).alias("key_length"), X.key_digest(F.col("text")).alias("digest"))


@query
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).select("email_id", X.stored_form(F.col("text")).alias("text"))


@query
def match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the match form, by number and digest."""
    found = F.regexp_extract_all(X.match_form(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    return _emails(spark, sf_dir).select("email_id", F.size(found).alias("n_words"), F.md5(F.concat_ws(" ", found)).alias("digest"))


@query
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5 on all HTML parts, decoded by their charset."""
    parts = table(spark, sf_dir, "message_parts").where("ctype = 'text/html' and payload is not null").drop("sent_at").distinct()
    return parts.select("source", "msg_no", "part_no", X.html_to_text(readers.decoded("payload", "charset")).alias("text"))


@query
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N9 and K5."""
    return _emails(spark, sf_dir).select("email_id", X.snippet(F.col("text")).alias("snippet"))


@query
def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10 on texts."""
    return _emails(spark, sf_dir).select("email_id", X.number(F.col("text")).alias("number"))


@query
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N11 on message subjects: how often each normalised title occurs; non-ASCII subjects are kept as they are."""
    parts = table(spark, sf_dir, "message_parts").where("subject is not null")
    return parts.select(X.title_form(F.col("subject")).alias("title")).groupBy("title").agg(F.count("*").alias("n"))


# -- screens and funnel ----------------------------------------------------------------------------------------------


@query
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).where(screen.length_ok(F.col("text"))).select("email_id", F.length("text").alias("n_chars"))


@query
def english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, hits = screen.stopword_share(F.col("text"))
    return _emails(spark, sf_dir).select("email_id", words.alias("n_words"), hits.alias("n_stopwords"), screen.looks_english(F.col("text")).alias("is_english"))


@query
def credential_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = screen.arms(F.col("text"))
    rows = _emails(spark, sf_dir).select("email_id", *[v.alias(k) for k, v in tests.items()])
    return rows.withColumn("retained", F.expr("has_subject and (has_action or has_call or has_url)"))


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails with the first rule they fail; the language rule holds for class 0 only."""
    rows = spread(table(spark, sf_dir, "emails").where("label is not null").select("email_id", "label", "source", "text"))
    return rows.withColumn("reason", screen.reason(F.col("text"), F.col("label") == 0))


@query
def corpus_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.funnel(_reasoned(spark, sf_dir), ["source"])


@query
def funnel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.funnel(_reasoned(spark, sf_dir), ["label"], rollup=True)


@query
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, screened, de-duplicated and balanced corpus of emails, as (email_id, label, source, text)."""
    rows = spread(table(spark, sf_dir, "emails").where("label in (0, 1)").select("email_id", "label", "source", X.stored_form(F.col("text")).alias("text")))
    judged = F.transform(F.array("text"), lambda t: F.struct(t.alias("text"), screen.reason(t, F.col("label") == 0).alias("reason")))
    kept = F.explode(F.filter(judged, lambda j: j["reason"] == "kept"))  # a generator, so that text and reason are computed once and not again for a filter
    rows = rows.select("email_id", "label", "source", kept.alias("j")).select("email_id", "label", "source", "j.text")
    return ranking.downsampled(cut(dedupe.class_dedupe(rows, "email_id"), "unique"), "label", "email_id")


@query
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "emails").groupBy("label").agg(F.count("*").alias("n"))


# -- exact de-duplication --------------------------------------------------------------------------------------------


@query
def dedupe_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.loader_dedupe(_emails(spark, sf_dir, "label"), "email_id").select("email_id", "label")


@query
def dedupe_alnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.class_dedupe(_emails(spark, sf_dir, "label"), "email_id").select("email_id", "label")


@query
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_count(_emails(spark, sf_dir), X.key_digest(F.col("text")))


# -- orders, splits and samples --------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "emails").where("label is not null").select("email_id", "label", "source")


@query
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_labelled(spark, sf_dir), ["label"], "email_id").select("email_id", "label", "rank")


@query
def balanced_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.downsampled(_labelled(spark, sf_dir), "label", "email_id").select("email_id", "label")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_split(_labelled(spark, sf_dir), "label", "email_id").select("email_id", "label", "split")


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_split(_labelled(spark, sf_dir), "label", "email_id").groupBy("label", "split").agg(F.count("*").alias("n"))


@query
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.folds(_labelled(spark, sf_dir), "label", "email_id").select("email_id", "label", "fold")


@query
def temporal_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year's messages of class 0 against class 1, balanced and split."""
    rows = table(spark, sf_dir, "emails").where("label = 1 or label = 0 and source like 'mbox-2022%'").select("email_id", "label")
    return ranking.stratified_split(ranking.downsampled(rows, "label", "email_id"), "label", "email_id")


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows for each source and decision of the screen."""
    rows = _emails(spark, sf_dir, "source").where("source is not null").withColumn("retained", screen.credential_screen(F.col("text"))).drop("text")
    return audit.sample(rows, ["source", "retained"], "email_id").select("email_id", "source", "retained", "rank")


@query
def audit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = _emails(spark, sf_dir, "source").where("source is not null").withColumn("retained", screen.credential_screen(F.col("text")))
    population = emails.groupBy("source").agg(F.count_if("retained").alias("retained"), F.count_if(~F.col("retained")).alias("excluded"))
    made = audit.score(table(spark, sf_dir, "screen_audit"), population)
    return made.select("source", *[F.round(c, 6).alias(c) for c in made.columns[1:]])


@query
def audit_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.agreement(table(spark, sf_dir, "screen_audit"))


# -- metrics ---------------------------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").distinct()


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir), ["model"])


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scores(metrics.confusion(_predictions(spark, sf_dir), ["model"]))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_predictions(spark, sf_dir), ["model"])


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.bootstrap_f1(metrics.confusion(_predictions(spark, sf_dir), ["model"]), ["model"])
    return made.select("model", *[F.round(c, 6).alias(c) for c in made.columns[1:]])


@query
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with the highest F1, the first by name among equals."""
    made = metrics.scores(metrics.confusion(_predictions(spark, sf_dir), ["model"]))
    return made.orderBy(F.desc("f1"), "model").limit(1).select("model", "f1")


@query
def readability_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _style(_emails(spark, sf_dir, "label").where("label in (0, 1)"), "flesch_reading_ease")
    return metrics.histogram(rows, "flesch_reading_ease", groups=["label"])


def _ranked_sources(spark: SparkSession, sf_dir: str, measure: F.Column) -> DataFrame:
    from pyspark.sql import Window

    per = table(spark, sf_dir, "emails").where("source is not null").groupBy("source").agg(measure.alias("m"))
    top = per.orderBy(F.desc("m"), "source").limit(20)
    return top.select("source", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("m"), "source")).alias("rank"))  # 20 rows


@query
def topk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest sources with their positions."""
    return _ranked_sources(spark, sf_dir, F.count("*"))


@query
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest sources by rows against the 20 largest by labelled rows of class 1."""
    made = metrics.spearman(_ranked_sources(spark, sf_dir, F.count("*")), _ranked_sources(spark, sf_dir, F.count_if(F.col("label") == 1)), "source")
    return made.select("n_common", F.round("rho", 6).alias("rho"), F.round("p_value", 6).alias("p_value"))


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "emails"), "label")


# -- similarity ------------------------------------------------------------------------------------------------------


@query
def char_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).select("email_id", F.size(X.shingles(F.col("text"))).alias("n_shingles"))


@query
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives of different keys at 0.5 or more."""
    _, reps = similarity.representatives(_emails(spark, sf_dir), "email_id")
    return similarity.similar_pairs(reps).withColumn("similarity", F.round("similarity", 9))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.clusters(_emails(spark, sf_dir), "email_id")


@query
def similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select(F.col("id").alias("email_id"), "cluster")


@query
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cluster_stats(_clusters(spark, sf_dir))


@query
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails").select("email_id", "label")
    return similarity.grouped_split(emails, "email_id", "label", _clusters(spark, sf_dir)).select(F.col("id").alias("email_id"), "cluster", "class", "split")


@query
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that the grouped split parts; there must be none."""
    emails = table(spark, sf_dir, "emails").select("email_id", "label")
    return similarity.leakage(similarity.grouped_split(emails, "email_id", "label", _clusters(spark, sf_dir)))
