"""Registered queries on models, checks and sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import style
from lexiloom.functions import text as X
from lexiloom.operators import checks, dedupe, metrics, models, ranking, screen, similarity
from lexiloom.plans.queries import _class_means, _emails, _labelled, _reasoned, query
from lexiloom.runtime import cut, shared_dir, table
from lexiloom.sources import readers, writers

NAMES = style.FEATURE_NAMES
CUES = ["email_addr_count", "url_count"]
MODELS = ("logreg", "forest", "boosted")
#: Parameters of all fits outside the grid search.
FOREST = {"numTrees": 200, "maxDepth": 10}
BOOST = {"maxIter": 100, "maxDepth": 3}
ROWS_PER_PARTITION = 20_000
MOST_ROWS_PER_PARTITION = 500_000


def _at_once(spark: SparkSession, *made: Callable) -> list:
    """Results of functions that run Spark jobs, run side by side: where jobs of one leave cores idle, those of another use them."""
    with ThreadPoolExecutor(len(made)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(f)) for f in made]]


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled texts without copies."""
    return dedupe.loader_dedupe(_emails(spark, sf_dir, "label", "source").where("label in (0, 1)"), "email_id")


def _matrix(spark: SparkSession, sf_dir: str, digits: int | None = None) -> DataFrame:
    """Features and split of all labelled texts; copies are dropped before the split."""
    return cut(style.features(ranking.stratified_split(_unique(spark, sf_dir), "label", "email_id"), digits=digits).drop("text"), "matrix")


def _unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix without a split, in even parts: features take far more time than the shuffle before them, whose parts adaptive execution would join by bytes."""
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut(style.features(_unique(spark, sf_dir).repartition(parts, "email_id")).drop("text"), "matrix")


def _described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All labelled texts, copies included, with their features, and the matrix, whose rows are taken from these."""
    rows = style.features(_emails(spark, sf_dir, "label", "source").where("label in (0, 1)")).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows, "described")
    kept = dedupe.loader_dedupe(rows.select("email_id", "text", "label", "source", "__row"), "email_id")
    split = ranking.stratified_split(kept.drop("text"), "label", "email_id").select("__row", "split")
    return rows, cut(rows.drop("text").join(split, "__row").drop("__row"), "matrix")


def _fit(kind: str, train: DataFrame, names: list[str]):
    """A model of the training part; class weights come from that part alone.

    Every iteration is a pass over all partitions, and from each partition a forest sends the statistics of all its nodes,
    whatever the number of rows; so there are no more partitions than cores unless they would get very large.
    """
    rows, n = models.weighted(train, positive_only=kind == "boosted"), train.count()
    cores, least = train.sparkSession.sparkContext.defaultParallelism, n // MOST_ROWS_PER_PARTITION
    few = max(1, min(cores, n // ROWS_PER_PARTITION), least)
    if kind == "logreg":
        return models.logistic(names, n).fit(rows.coalesce(few))
    if kind == "forest":
        return models.forest(names, **FOREST).fit(rows.repartition(max(cores, least), "email_id"))
    return models.boosted(names, **BOOST).fit(rows.repartition(few, "email_id"))


def _scored(kind: str, df: DataFrame, names: list[str] = NAMES) -> DataFrame:
    return models.predictions(_fit(kind, df.where("split = 'train'"), names), df.where("split = 'test'"), "email_id").withColumn("model", F.lit(kind))


def _result(kind: str, df: DataFrame, names: list[str] = NAMES) -> DataFrame:
    return models.evaluated(cut(_scored(kind, df, names), "scored")).withColumn("model", F.lit(kind))


def _results(df: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """All models' results; the models are fitted side by side."""
    return reduce(DataFrame.unionByName, _at_once(df.sparkSession, *[lambda kind=kind: _result(kind, df, names) for kind in MODELS]))


def _temporal(matrix: DataFrame) -> DataFrame:
    """Class 1 and the one year's mailboxes of class 0, balanced and split anew."""
    df = matrix.where("label = 1 or source like 'mbox-2022%'").drop("split")
    return cut(ranking.stratified_split(ranking.downsampled(df, "label", "email_id"), "label", "email_id"), "subset")


def _grouped(spark: SparkSession, sf_dir: str, matrix: DataFrame | None = None) -> DataFrame:
    """The matrix, made beside the clusters if not given, with a split that keeps similar texts together, and their cluster."""
    made, found = _at_once(spark, lambda: _unsplit(spark, sf_dir) if matrix is None else matrix, lambda: similarity.clusters(_emails(spark, sf_dir), "email_id"))
    df = made.drop("split")
    placed = similarity.grouped_split(df.select("email_id", "label"), "email_id", "label", found).select(F.col("id").alias("email_id"), "cluster", "split")
    return cut(df.join(placed, "email_id"), "grouped")


@query
def logreg_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result("logreg", _matrix(spark, sf_dir))


@query
def rf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result("forest", _matrix(spark, sf_dir))


@query
def gbt_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result("boosted", _matrix(spark, sf_dir))


@query
def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: de-duplicated corpus, split, features, three models, their scores with intervals, and which is best by F1."""
    made = cut(_results(_matrix(spark, sf_dir)), "results")
    return made.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "model")) == 1)  # one row a model


@query
def descent_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient descent on the features of the sample texts, three quarters of them in hash order against the rest."""
    rows = style.features(readers.synthetic(spark)).drop("text")
    rows = cut(ranking.ranked(rows, [], "id", size="of").withColumn("split", F.when(F.col("rank") <= F.floor(F.col("of") * 0.75), "train").otherwise("test")), "sample")
    model = models.descent(rows.where("split = 'train'"), NAMES)
    return models.evaluated(model.scored(rows.where("split = 'test'"), "id"))


@query
def grid_search_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 with a reduced grid: best parameters by F1 over five stratified folds, scored on the test part."""
    df = _matrix(spark, sf_dir)
    train = cut(ranking.folds(models.weighted(df.where("split = 'train'")), "label", "email_id"), "folds")
    model, best = models.grid_search(models.forest(NAMES, numTrees=10), train, {"maxDepth": [4, 8]})
    made = models.evaluated(models.predictions(model, df.where("split = 'test'"), "email_id"))
    return made.withColumn("best_max_depth", F.lit(best["maxDepth"]))


@query
def ablation_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 and M8: every model with all features and without the structural cues."""
    df = _matrix(spark, sf_dir)
    kept = [n for n in NAMES if n not in CUES]
    return _results(df).withColumn("condition", F.lit("all")).unionByName(_results(df.drop(*CUES), kept).withColumn("condition", F.lit("without_cues")))


@query
def temporal_subset_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(_temporal(_matrix(spark, sf_dir)))


@query
def grouped_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: every model refitted on a split that keeps similar texts together."""
    return _results(_grouped(spark, sf_dir))


@query
def impurity_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.impurity_importance(_fit("forest", _matrix(spark, sf_dir).where("split = 'train'"), NAMES), NAMES)


@query
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _matrix(spark, sf_dir)
    return models.permutation_importance(_fit("logreg", df.where("split = 'train'"), NAMES), df.where("split = 'test'"), NAMES, "email_id", repeats=10)


def _importances(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked impurity and permutation importance of the forest."""
    model = _fit("forest", df.where("split = 'train'"), NAMES)
    drops = models.permutation_importance(model, df.where("split = 'test'"), NAMES, "email_id", repeats=10)
    top = drops.select("feature", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_drop"), "feature")).alias("rank"))  # one row a feature
    return models.impurity_importance(model, NAMES), top


@query
def importance_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impurity against permutation importance of the forest."""
    return metrics.spearman(*_importances(_matrix(spark, sf_dir)), "feature")


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 features to six digits and the split of every labelled text."""
    return _matrix(spark, sf_dir, digits=6)


# -- checks ----------------------------------------------------------------------------------------------------------


@query
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of corpus, funnel, split and metrics, each with the number it rests on."""
    kept = dedupe.class_dedupe(_emails(spark, sf_dir, "label").where(F.col("label").isNotNull() & F.col("text").rlike(f"[^{X.SPACE}]")), "email_id")
    balanced = ranking.downsampled(kept, "label", "email_id")
    funnel = screen.funnel(_reasoned(spark, sf_dir), ["source"])
    split = ranking.stratified_split(_labelled(spark, sf_dir), "label", "email_id")
    cells = metrics.scores(metrics.confusion(table(spark, sf_dir, "predictions").distinct(), ["model"]))
    again = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    parts = F.expr("excluded_internal + excluded_length + excluded_language + excluded_screen + kept")
    return checks.report([
        checks.none_of(kept.where("text is null"), "no null texts", "corpus"),
        checks.none_of(kept.where("label not in (0, 1)"), "labels are 0 or 1", "corpus"),
        checks.none_of(kept.groupBy("label", X.key_digest(F.col("text")).alias("k")).count().where("count > 1"), "no copies inside a class", "corpus"),
        checks.none_of(balanced.groupBy("label").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).where("a <> b"), "classes are balanced", "corpus"),
        checks.none_of(kept.where(~F.col("text").rlike(f"[^{X.SPACE}]")), "no blank texts", "corpus"),
        checks.none_of(funnel.where(parts != F.col("messages")), "funnel adds up", "funnel"),
        checks.check(funnel, "messages are counted", "funnel", F.sum("messages"), F.col("value") > 0),
        checks.none_of(split.where("split not in ('train', 'val', 'test')"), "every row has a split", "split"),
        checks.none_of(split.groupBy("email_id").count().where("count > 1"), "no row in two splits", "split"),
        checks.none_of(split.agg(F.count("*").alias("n")).crossJoin(F.broadcast(_labelled(spark, sf_dir).agg(F.count("*").alias("m")))).where("n <> m"), "parts add up to the corpus", "split"),
        checks.none_of(ranking.stratified_split(balanced, "label", "email_id").where("split = 'test'").groupBy("label").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).where("a <> b"), "balanced test part holds as many of each class", "split"),
        checks.none_of(cells.where(~metrics.close_to(F.col("f1"), again, 1e-6)), "f1 follows from precision and recall", "models"),
        checks.none_of(cells.where("precision < 0 or precision > 1 or recall < 0 or recall > 1"), "ratios are ratios", "models"),
    ])


@query
def robustness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of what the models reported and of the three robustness conditions; no model is fitted twice."""
    df = _matrix(spark, sf_dir)
    made = cut(_results(df), "results")
    n_test = df.where("split = 'test'").agg(F.count("*").alias("n"))
    again = metrics.scores(made.select("model", "tn", "fp", "fn", "tp"))
    printed = made.select("model", *[F.bround(c, 3).alias(c) for c in ("precision", "recall", "f1", "auc", "accuracy")])
    grouped, labelled = _grouped(spark, sf_dir, df), df.agg(F.count("*").alias("n"))
    test = grouped.where("split = 'test'")
    redone = similarity.grouped_split(df.select("email_id", "label"), "email_id", "label", grouped.select(F.col("email_id").alias("id"), "cluster")).groupBy("split").agg(F.count("*").alias("n"))
    subset = _temporal(df)
    smaller = df.where("label = 1 or source like 'mbox-2022%'").groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    sizes = ranking.stratified_split(subset.drop("split"), "label", "email_id").groupBy("split").agg(F.count("*").alias("n"))
    kept = [n for n in NAMES if n not in CUES]
    per_model = [
        check
        for kind in MODELS
        for check in (
            checks.none_of(made.where(F.col("model") == kind).crossJoin(F.broadcast(n_test)).where("tn + fp + fn + tp <> n"), f"{kind}: matrix adds up to the test part", "models"),
            checks.none_of(checks.differing(made.where(F.col("model") == kind), again, ["model"], ["precision", "recall", "f1", "accuracy"], 1e-6).where(F.col("model") == kind), f"{kind}: scores follow from the matrix", "models"),
            checks.none_of(made.where((F.col("model") == kind) & ~F.col("f1").between(F.col("ci_low") - 5e-4, F.col("ci_high") + 5e-4)), f"{kind}: f1 lies in its interval", "models"),
        )
    ]
    return checks.report([
        *per_model,
        checks.none_of(checks.differing(made, printed, ["model"], ["precision", "recall", "f1", "auc", "accuracy"], 5e-4 + 1e-9), "printed table agrees with the results", "models"),
        checks.check(n_test, "only the two cues are left out", "robustness", F.lit(len(NAMES) - len(kept)), (F.col("value") == 2) & F.lit(sorted(set(NAMES) - set(kept)) == sorted(CUES))),
        checks.none_of(grouped.agg(F.count("*").alias("m")).crossJoin(F.broadcast(labelled)).where("m <> n"), "grouped parts add up to the corpus", "robustness"),
        checks.none_of(test.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).where("p + q <> n"), "grouped classes add up to the test part", "robustness"),
        checks.none_of(similarity.leakage(grouped.select("cluster", "split")), "no cluster is parted", "robustness"),
        checks.none_of(checks.differing(grouped.groupBy("split").agg(F.count("*").alias("n")), redone, ["split"], ["n"], 0), "grouped sizes come out again", "robustness"),
        checks.none_of(subset.where("split = 'test'").groupBy("label").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).where("a <> b"), "subset's test part is balanced", "robustness"),
        checks.none_of(subset.groupBy("label").agg(F.count("*").alias("m")).crossJoin(F.broadcast(smaller)).where("m <> n"), "subset has the smaller class's size", "robustness"),
        checks.none_of(checks.differing(subset.groupBy("split").agg(F.count("*").alias("n")), sizes, ["split"], ["n"], 0), "subset's sizes come out again", "robustness"),
        checks.none_of(subset.where("split is null or split not in ('train', 'val', 'test')"), "subset's parts add up", "robustness"),
    ])


@query
def feature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means written as JSON and as a table of six decimals agree when read again (J6); both importances share what they say they share."""
    rows, matrix = _described(spark, sf_dir)
    means = cut(_class_means(rows.select("label", *[F.round(c, 6).alias(c) for c in style.FOCUS])), "means")
    path = f"{shared_dir(spark)}/means-{uuid.uuid4().hex}"
    writers.write_json(means, f"{path}-json")
    writers.write_table_csv(means, f"{path}-csv")
    said, shown = readers.read_json(spark, f"{path}-json", lines=True), spark.read.csv(f"{path}-csv", header=True)
    impurity, top = (cut(x, "ranked") for x in _importances(matrix))
    agreed = metrics.spearman(impurity, top, "feature")
    common = impurity.join(top.where("rank <= 20"), "feature").agg(F.count("*").alias("n"))
    return checks.report([
        checks.none_of(checks.differing(said, shown, ["feature"], ["class_0", "class_1"], 1e-6), "means table agrees with the means document", "features"),
        checks.none_of(agreed.crossJoin(F.broadcast(common)).where("n_common <> n"), "importances share what they say", "features"),
        checks.none_of(agreed.where("rho not between -1 and 1 or p_value not between 0 and 1"), "rank correlation and p-value are in range", "features"),
    ])


@query
def checksum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the test tables, recorded and computed again."""
    found = cut(readers.file_digests(spark, f"{sf_dir}/*.parquet"), "digests")
    stored = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return checks.report([checks.none_of(checks.wrong_digests(stored, readers.file_digests(spark, f"{sf_dir}/*.parquet")), "digests of the sources agree", "checksums")])


@query
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(validation_report(spark, sf_dir))


# -- sources ---------------------------------------------------------------------------------------------------------


@query
def message_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.message_bodies(table(spark, sf_dir, "message_parts").drop("sent_at"))


@query
def message_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, N3, P1-P4 and A4 on raw messages."""
    bodies = readers.message_bodies(table(spark, sf_dir, "message_parts").drop("sent_at"))
    judged = bodies.withColumn("text", X.stored_form(F.col("body"))).withColumn("reason", screen.reason(F.col("text"), F.lit(True)))
    return screen.funnel(judged, ["source"])


@query
def synthetic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.synthetic(spark)


@query
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: whether each source of the audit was judged in full, as allowed statuses."""
    rows = table(spark, sf_dir, "screen_audit").groupBy("source").agg(F.count("*").alias("n"), F.count("judged_in_scope").alias("judged"))
    status = F.when(F.col("judged") == F.col("n"), writers.STATUSES[0]).when(F.col("judged") > 0, writers.STATUSES[1]).otherwise(writers.STATUSES[3])
    return writers.status_histogram(rows.withColumn("status", status))


@query
def seeded_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """75/25 by hash order over all rows."""
    rows = ranking.ranked(table(spark, sf_dir, "emails").select("email_id"), [], "email_id", lexicons.SEED, size="n")
    return rows.select("email_id", F.when(F.col("rank") <= F.floor(F.col("n") * 0.75), "train").otherwise("test").alias("part"))
