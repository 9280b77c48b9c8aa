"""Classifiers on style features: fitting, grid search, prediction, importance, ablation.

Data frames carry an id, a label in {0, 1} and the features as DOUBLE columns. Rows with a null label are never used for
fitting or scoring. Fitting on one class only is an error of the learner; an empty data frame cannot be fitted.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.operators import metrics
from lexiloom.operators.ranking import ranked
from lexiloom.runtime import cut, shared_dir

FOREST_GRID = {"numTrees": [200, 400], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2, 5]}
BOOST_GRID = {"maxIter": [300, 600], "maxDepth": [3, 6], "stepSize": [0.05, 0.1], "subsamplingRate": [0.8, 1.0]}


def weighted(df: DataFrame, label: str = "label", positive_only: bool = False) -> DataFrame:
    """df, the training part, with the balanced class weight of each row in `weight`; or with that of class 1 against class 0."""
    if positive_only:
        one = metrics.scale_pos_weight(df, label).select(F.col("weight").alias("__w"))
        return df.crossJoin(F.broadcast(one)).withColumn("weight", F.when(F.col(label) == 1, F.col("__w")).otherwise(1.0)).drop("__w")  # one row
    weights = metrics.class_weights(df, label).select(F.col(label).alias("__l"), "weight")
    return df.join(F.broadcast(weights), df[label] == F.col("__l")).drop("__l")  # one row a class


def logistic(names: list[str], n: int, label: str = "label") -> Pipeline:
    """Standardised L2 logistic regression with C=1 on n rows whose weights add up to n: in Spark's scaling lambda is 1/n.

    Features are divided by the standard deviation of the population; Spark's scaler divides by that of a sample.
    """
    learner = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, maxIter=1000, standardization=False)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="sample_scaled")
    population = ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(n / max(1, n - 1))] * len(names)), inputCol="sample_scaled", outputCol="scaled")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), scaler, population, learner])


def forest(names: list[str], label: str = "label", **params) -> Pipeline:
    learner = RandomForestClassifier(labelCol=label, weightCol="weight", seed=lexicons.SEED, **({"numTrees": 200, "maxDepth": 10} | params))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), learner])


def boosted(names: list[str], label: str = "label", **params) -> Pipeline:
    learner = GBTClassifier(labelCol=label, weightCol="weight", seed=lexicons.SEED, **({"maxIter": 300, "maxDepth": 3, "stepSize": 0.1} | params))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), learner])


def grid_search(pipeline: Pipeline, df: DataFrame, grid: dict[str, list], label: str = "label", fold: str = "fold", parallelism: int = 4) -> tuple[PipelineModel, dict]:
    """The pipeline refitted with the parameters of the best F1 over the folds of column `fold`, and those parameters."""
    learner = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(learner.getParam(name), values)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
    folds = df.select(F.max(fold)).first()[0] + 1
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, foldCol=fold, parallelism=parallelism).fit(df)
    best = found.bestModel.stages[-1]
    return found.bestModel, {name: best.getOrDefault(name) for name in grid}


@dataclass(frozen=True)
class Linear:
    """Weights for standardised features and an intercept; features are standardised by the means and deviations given."""

    names: list[str]
    weights: list[float]
    intercept: float
    means: list[float]
    deviations: list[float]

    def scored(self, df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
        """(id, y_true, y_pred, score): probability of class 1, class 1 from 0.5 on."""
        terms = (F.lit(w) * (F.col(f"`{n}`") - m) / (s or 1.0) for n, w, m, s in zip(self.names, self.weights, self.means, self.deviations))
        score = metrics.sigmoid(sum(terms, F.lit(self.intercept)))
        return df.select(id_col, F.col(label).cast("int").alias("y_true"), metrics.thresholded(score).alias("y_pred"), score.alias("score"))


def descent(df: DataFrame, names: list[str], label: str = "label", rate: float = 0.1, epochs: int = 400, l2: float = 1e-3, seed: int = lexicons.SEED) -> Linear:
    """Logistic regression by full-batch gradient descent on standardised features (M9).

    Every epoch is one pass over the data; a task sums the gradients of its rows, so that one vector a task reaches the driver.
    Rows with a null label or feature do not count; no rows are an error.
    """
    rows = df.select(F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null and not exists(x, v -> v is null)")
    rows = cut(rows, "descent")
    stats = rows.select(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(names)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = stats["n"]
    if not n:
        raise ValueError("no rows to fit")
    mean, sd = (np.array([stats[f"{k}{i}"] for i in range(len(names))]) for k in "ms")
    w, b = np.random.default_rng(seed).normal(0, 0.01, len(names)), 0.0
    for _ in range(epochs):

        def gradients(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, b: float = b) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 1)
            for batch in batches:
                x = (batch.column("x").flatten().to_numpy().reshape(-1, len(w)) - mean) / np.where(sd == 0, 1.0, sd)
                off = 1 / (1 + np.exp(-(x @ w + b))) - batch.column("y").to_numpy()
                total += np.append(x.T @ off, off.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

        g = np.sum([r["g"] for r in rows.mapInArrow(gradients, "g array<double>").collect()], axis=0) / n  # one row a task
        w, b = w - rate * (g[:-1] + l2 * w), b - rate * g[-1]
    return Linear(names, w.tolist(), float(b), mean.tolist(), sd.tolist())


def predictions(model: PipelineModel, df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """(id, y_true, y_pred, score)."""
    out = model.transform(df)
    return out.select(id_col, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability")[1].alias("score"))


def evaluated(scored: DataFrame) -> DataFrame:
    """One row: confusion counts, precision, recall, f1, accuracy, auc and the bootstrap interval of f1."""
    one = scored.withColumn("__all", F.lit(1))
    cells = metrics.confusion(one, ["__all"])
    interval = metrics.fast_bootstrap_f1(cells, ["__all"]).drop("f1_mean")
    return metrics.scores(cells).join(metrics.roc_auc(one, ["__all"]), "__all").join(interval, "__all").drop("__all", "n_pos", "n_neg")


def impurity_importance(model: PipelineModel, names: list[str], k: int = 20) -> DataFrame:
    """(feature, importance, rank) of the k most important features of a tree model; none for a model without importances."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist() if hasattr(model.stages[-1], "featureImportances") else []
    top = sorted(zip(names, values), key=lambda x: (-x[1], x[0]))[:k]
    return SparkSession.active().createDataFrame([(f, float(v), i) for i, (f, v) in enumerate(top, 1)], "feature string, importance double, rank int")


def _trees(model: RandomForestClassificationModel) -> list[tuple[np.ndarray, ...]]:
    """Of every tree in order: feature (-1 in leaves), threshold, left child, right child and the votes for both classes of each node."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select("treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("f"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("at"), node["split"]["numCategories"].alias("kinds"), node["leftChild"].alias("l"), node["rightChild"].alias("r"), node["impurityStats"].alias("stats"))
    frame = rows.toPandas().sort_values(["treeID", "id"])  # the model, which the driver holds already
    out = []
    for _, own in frame.groupby("treeID"):
        leaf = own["l"].to_numpy() < 0
        if (own["kinds"].to_numpy()[~leaf] != -1).any() or (own["id"].to_numpy() != np.arange(len(own))).any():
            raise ValueError("splits must be thresholds, nodes numbered from 0")
        stats = np.array([list(x) for x in own["stats"]])
        total = stats.sum(1, keepdims=True)
        votes = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
        out.append((np.where(leaf, -1, own["f"].to_numpy()).astype(np.int32), np.where(leaf, 0.0, own["at"].to_numpy(dtype=np.float64)), own["l"].to_numpy().astype(np.int32), own["r"].to_numpy().astype(np.int32), votes))
    return out


def _dealt(trees: list[tuple[np.ndarray, ...]], k: int, size: int = 2048):
    """(feature, repeat, tn, fp, fn, tp) of rows (y, repeat, values, other) when each feature in turn has the other's value.

    A tree's answer changes only if the other value turns a node on the row's path; from the first such node on the path is
    followed anew. Votes are added up in the order of the trees, as the model does.
    """

    def part(y: np.ndarray, x: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Class that each row (axis 1) gets with each feature (axis 0) dealt."""
        n, every = len(y), np.arange(len(y))
        votes = np.zeros((2, len(trees), n))
        changed = []  # (tree, row, feature, leaf)
        for t, (feature, at, left, right, said) in enumerate(trees):
            node, rows = np.zeros(n, np.int32), every
            turned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            seen = np.zeros((n, k), bool)
            leaf = np.zeros(n, np.int32)
            while len(rows):
                f = feature[node]
                ends = f < 0
                leaf[rows[ends]] = node[ends]
                rows, node, f = rows[~ends], node[~ends], f[~ends]
                low, other = x[rows, f] <= at[node], o[rows, f] <= at[node]
                new = np.flatnonzero((low != other) & ~seen[rows, f])
                seen[rows[new], f[new]] = True
                turned.append((rows[new], f[new], np.where(other[new], left[node[new]], right[node[new]])))
                node = np.where(low, left[node], right[node])
            votes[:, t] = said[leaf].T
            row, own, node = (np.concatenate(c) for c in zip(*turned))
            live = np.arange(len(row))
            while len(live):
                f = feature[node[live]]
                live, f = live[f >= 0], f[f >= 0]
                r, here = row[live], node[live]
                value = np.where(f == own[live], o[r, f], x[r, f])
                node[live] = np.where(value <= at[here], left[here], right[here])
            moved = (said[node] != said[leaf[row]]).any(1)
            changed.append((np.full(moved.sum(), t), row[moved], own[moved], said[node[moved]]))
        tree, row, own, new = (np.concatenate(c) for c in zip(*changed))
        order = np.argsort(own, kind="stable")
        tree, row, new = tree[order], row[order], new[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=k))])
        total = np.add.reduce(votes, axis=1)  # tree after tree
        out = np.repeat((total[1] > total[0])[None], k, 0)
        for f in range(k):
            a, b = ends[f], ends[f + 1]
            if b > a:
                hit, where = np.unique(row[a:b], return_inverse=True)
                again = votes[:, :, hit]
                again[:, tree[a:b], where] = new[a:b].T
                total = np.add.reduce(again, axis=1)
                out[f, hit] = total[1] > total[0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, size) for whole in batches for i in range(0, whole.num_rows, size)):
            y, repeat = batch.column("y").to_numpy(), batch.column("repeat").to_numpy()
            x, o = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in ("values", "other"))
            said = part(y, x, o)
            for which in np.unique(repeat):
                own = repeat == which
                cells = [(said[:, own] == p)[:, y[own] == t].sum(1) for t, p in ((0, False), (0, True), (1, False), (1, True))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, which, np.int32)), *map(pa.array, cells)], ["feature", "repeat", "tn", "fp", "fn", "tp"])

    return run


def permutation_importance(model: PipelineModel, df: DataFrame, names: list[str], id_col: str, label: str = "label", repeats: int = 10, seed: int = lexicons.SEED) -> DataFrame:
    """(feature, mean_drop, std_drop): loss of F1 when a feature's values are dealt anew among the rows.

    Rows stand in hash order; for each repeat a hashed shift of that order says whose values a row gets, so each row meets one
    donor a repeat, and only then takes one feature after the other from it. Counts alone are shuffled afterwards. In a
    forest only those paths are followed anew that a dealt value turns (_dealt).
    """
    rows = ranked(df.where(F.col(label).isNotNull()), [], id_col, seed, size="n").withColumn("values", F.array(*names)).select(id_col, label, "rank", "n", "values")
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    shift = 1 + F.pmod(F.xxhash64(F.lit(seed), "repeat"), F.greatest(F.col("n") - 1, F.lit(1)))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # a number, since adaptive execution would join rows this few in one task
    every = rows.repartition(tasks, "rank").withColumn("repeat", repeat).withColumn("from", 1 + (F.col("rank") - 1 + shift) % F.col("n"))
    donors = rows.select(F.col("rank").alias("from"), F.col("values").alias("other"))
    met = every.join(donors, "from")
    base = metrics.scores(metrics.confusion(predictions(model, df.where(F.col(label).isNotNull()), id_col, label).withColumn("a", F.lit(1)), ["a"])).select(F.col("f1").alias("base"))
    if isinstance(model.stages[-1], RandomForestClassificationModel):
        counted = met.select(F.col(label).cast("int").alias("y"), "repeat", "values", "other").mapInArrow(_dealt(_trees(model.stages[-1]), len(names)), "feature int, repeat int, tn long, fp long, fn long, tp long")
        cells = counted.groupBy("feature", "repeat").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    else:
        met = met.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
        dealt = met.withColumn("values", F.transform("values", lambda v, i: F.when(i == F.col("feature"), F.element_at("other", F.col("feature") + 1)).otherwise(v)))
        vectors = dealt.withColumn("features", array_to_vector("values"))
        for stage in model.stages[1:]:
            vectors = stage.transform(vectors)
        cells = metrics.confusion(vectors.withColumn("y_true", F.col(label).cast("int")).withColumn("y_pred", F.col("prediction").cast("int")), ["feature", "repeat"])
    drops = metrics.scores(cells).crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("f1"))  # one row
    per = drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1)
    return per.select(named.alias("feature"), "mean_drop", "std_drop")
