"""Evaluation metrics on (y_true, y_pred, score) rows, overall or per group.

Rows with a null label or prediction do not count; a null score leaves its row out of the AUC only. A ratio with an empty
denominator is 0, an AUC with an empty class is null. Empty input gives no groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import md5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, groups: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """groups, tn, fp, fn, tp."""
    cell = lambda t, p: F.count_if((F.col(true) == t) & (F.col(pred) == p))
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*groups).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def scores(cells: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy to confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "accuracy": _ratio(tp + tn, tp + tn + fp + fn)})


def roc_auc(df: DataFrame, groups: list[str], true: str = "y_true", score: str = "score", ranges: int = 4096) -> DataFrame:
    """groups, n_pos, n_neg, auc: the exact rank statistic with half credit for ties.

    Scores in [0, 1] fall into ranges whose negatives are added up first; only scores of one range are sorted together.
    """
    rows = df.where(F.col(true).isin(0, 1) & F.col(score).isNotNull())
    per = rows.groupBy(*groups, F.col(score).alias("__s")).agg(F.count_if(F.col(true) == 1).alias("__p"), F.count_if(F.col(true) == 0).alias("__n"))
    per = per.withColumn("__r", F.least(F.greatest(F.floor(F.col("__s") * ranges), F.lit(-1)), F.lit(ranges)).cast("int"))
    sums = per.groupBy(*groups, "__r").agg(F.sum("__n").alias("__m"))
    ahead = Window.partitionBy(*groups).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__m").over(ahead), F.lit(0))).drop("__m")
    inside = Window.partitionBy(*groups, "__r").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(sums, [*groups, "__r"]).withColumn("__below", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    twice = F.sum(F.col("__p") * (2 * F.col("__below") + F.col("__n")))  # integers, so that no order of addition matters
    out = per.groupBy(*groups).agg(F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), twice.alias("__w"))
    return out.withColumn("auc", F.try_divide(F.col("__w").cast("double"), (2 * F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("__w")


def bootstrap_f1(cells: DataFrame, groups: list[str], n_boot: int = lexicons.N_BOOT, alpha: float = lexicons.ALPHA, seed: int = lexicons.SEED) -> DataFrame:
    """groups, f1_mean, ci_low, ci_high: percentile interval of F1 over n_boot resamples.

    Draw i of replicate b takes row h mod n, h being the (i mod 4)-th 32 bits of md5(seed:b:i div 4), which any engine computes
    alike. F1 needs only the cell of a row, so rows are laid out cell after cell and no join is made. Digests are computed
    once a replicate for all groups, and only counts leave a task.
    """
    sized = cells.select(*groups, "tn", "fp", "fn", "tp").withColumn("__size", F.expr("tn + fp + fn + tp")).where("__size > 0")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*groups).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, tn, fp, fn, b = (batch.column(c).to_pylist() for c in ("__size", "tn", "fp", "fn", "__b"))
            counts = np.zeros((batch.num_rows, 3), np.int64)  # draws behind tn, behind fp, behind fn
            own: dict[int, list[int]] = {}
            for i, which in enumerate(b):
                own.setdefault(which, []).append(i)
            for which, rows in own.items():
                for first, four in md5.numbered(f"{seed}:{which}:", (max(size[i] for i in rows) + 3) // 4):
                    for i in rows:
                        for k, h in enumerate(four):
                            h = h[: max(0, (size[i] - k + 3) // 4 - first)]  # draws 4 * j + k below the size
                            at = h - h // np.uint32(size[i]) * np.uint32(size[i]) if size[i] < 1 << 32 else h
                            counts[i] += [int(np.count_nonzero(at >= x)) for x in (tn[i], tn[i] + fp[i], tn[i] + fp[i] + fn[i])]
            drawn = (counts[:, 0] - counts[:, 1], counts[:, 1] - counts[:, 2], counts[:, 2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in groups), *map(pa.array, drawn)], [*groups, "fp", "fn", "tp"])

    draws = sized.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    tasks = 4 * cells.sparkSession.sparkContext.defaultParallelism  # a number, since adaptive execution would join rows this small in one task
    drawn = draws.repartition(tasks, "__b").sortWithinPartitions("__b").mapInArrow(run, f"{fields}, fp long, fn long, tp long")
    f1 = drawn.withColumn("__f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    low_high = F.percentile("__f1", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = f1.groupBy(*groups).agg(F.avg("__f1").alias("f1_mean"), low_high.alias("__q"))
    return out.select(*groups, "f1_mean", F.col("__q")[0].alias("ci_low"), F.col("__q")[1].alias("ci_high"))


def fast_bootstrap_f1(cells: DataFrame, groups: list[str], n_boot: int = lexicons.N_BOOT, alpha: float = lexicons.ALPHA, seed: int = lexicons.SEED) -> DataFrame:
    """The same interval in time that does not depend on the number of rows: the cells of a resample are one multinomial draw.

    Draws come from a generator seeded by `seed` and the group's values, one task a group. Groups without rows are left out.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*groups).schema)

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        counts = frame[["tn", "fp", "fn", "tp"]].sum().to_numpy(dtype=np.int64)
        own = zlib.crc32(repr([str(v) for v in frame[groups].iloc[0]]).encode())
        drawn = np.random.default_rng([seed, own]).multinomial(counts.sum(), counts / counts.sum(), n_boot)
        below = 2 * drawn[:, 3] + drawn[:, 1] + drawn[:, 2]
        f1 = np.where(below > 0, 2 * drawn[:, 3] / np.maximum(below, 1), 0.0)
        low, high = np.quantile(f1, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*frame[groups].iloc[0], f1.mean(), low, high]], columns=[*groups, "f1_mean", "ci_low", "ci_high"])

    sized = cells.select(*groups, "tn", "fp", "fn", "tp").where("tn + fp + fn + tp > 0")
    return sized.groupBy(*groups).applyInPandas(interval, f"{fields}, f1_mean double, ci_low double, ci_high double")


def histogram(values: DataFrame, column: str, low: float = -20.0, high: float = 120.0, edges: int = 40, groups: list[str] = ()) -> DataFrame:
    """groups, bin, n for the edges-1 equal bins of [low, high]; the last bin is closed, values outside are dropped."""
    width, bins = (high - low) / (edges - 1), edges - 1
    inside = values.where(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*groups, at.alias("bin")).agg(F.count("*").alias("n"))


def spearman(left: DataFrame, right: DataFrame, on: str, k: int = 20) -> DataFrame:
    """One row (n_common, rho, p_value): common names among the first k of two ranked lists (name, rank), the correlation of
    their re-numbered ranks and its two-sided p-value.

    Fewer than three common names have no p-value; a correlation of 1 or -1 has 0.
    """
    x, y = (df.where(F.col("rank") <= k).select(on, F.col("rank").alias(r)) for df, r in ((left, "rx"), (right, "ry")))
    both = x.join(y, on)  # at most k rows
    again = both.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rx")).alias("a"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ry")).alias("b"))
    n = F.count("*")
    d2 = F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    out = again.agg(n.alias("n_common"), (1 - F.try_divide(6 * d2.cast("double"), (n * (n * n - 1)).cast("double"))).alias("rho"))
    nu = F.col("n_common") - 2
    t = F.abs("rho") * F.sqrt(F.try_divide(nu.cast("double"), 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, 0.0).otherwise(student_p(t, nu))
    return out.withColumn("p_value", F.when(F.col("n_common") > 2, p))


def student_p(t: Column, nu: Column) -> Column:
    """Two-sided p-value of Student's t >= 0 with a whole number of degrees of freedom, by the finite series of its distribution."""
    theta = F.atan(t / F.sqrt(nu.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = nu % 2 == 1
    # even: 1 + 1/2 c2 + 1*3/(2*4) c2^2 ...; odd: 1 + 2/3 c2 + 2*4/(3*5) c2^2 ...
    terms = F.when(odd, F.floor((nu - 3) / 2)).otherwise(F.floor((nu - 2) / 2)).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j)) * cos2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(steps, start, lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["sum"] + a["term"] * ratio(j)).alias("sum")), lambda a: a["sum"])
    inner = F.when(nu == 1, 2 * theta / math.pi).when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * series)).otherwise(F.sin(theta) * series)
    return 1 - inner


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, balanced weight n/(classes*n_c); null labels do not count."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row a class
    return per.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """One row (n_negative, n_positive, weight): what a row of class 1 weighs against one of class 0, negatives by positives, at least by 1."""
    out = df.agg(F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive"))
    return out.withColumn("weight", F.col("n_negative") / F.greatest("n_positive", F.lit(1)))


def sigmoid(margin: Column) -> Column:
    """Probability of class 1 for the margin of a linear model (X4); a null margin gives null."""
    return 1 / (1 + F.exp(-margin))


def thresholded(probability: Column, least: float = 0.5) -> Column:
    """Class 1 from a probability of `least` on."""
    return (probability >= least).cast("int")


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
