"""Stratified audit of a screen and its score.

Defined results: judgements that are null do not count; whole-row copies count once; a stratum without judgements has null
rates and a source without them a null recall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.operators.ranking import first_per_group


def sample(df: DataFrame, strata: list[str], key: str, k: int = lexicons.AUDIT_PER_STRATUM, seed: int = lexicons.SEED) -> DataFrame:
    """The first k rows of each stratum in hash order."""
    return first_per_group(df, strata, key, k, seed)


def agreement(judged: DataFrame) -> DataFrame:
    """source, screen_retained, n, in_scope: judgements per stratum."""
    rows = judged.distinct().where("judged_in_scope is not null and screen_retained is not null")
    return rows.groupBy("source", "screen_retained").agg(F.count("*").alias("n"), F.count_if("judged_in_scope").alias("in_scope"))


def disagreements(sampled: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The sample with judged_in_scope (J3): what the screen decided, but the opposite for keys named in `keys`.

    Keys are (key) rows, named once or several times; a null key agrees.
    """
    named = keys.select(F.col(key).alias("__key")).where("__key is not null").distinct().withColumn("__named", F.lit(True))
    joined = sampled.join(named, sampled[key] == F.col("__key"), "left")
    return joined.withColumn("judged_in_scope", F.col("screen_retained") != F.coalesce("__named", F.lit(False))).drop("__key", "__named")


def score(judged: DataFrame, population: DataFrame) -> DataFrame:
    """source, precision, fn_rate, est_in_scope, est_missed, recall; population is (source, retained, excluded) counts."""
    a = agreement(judged)
    rate = F.try_divide(F.sum("in_scope").cast("double"), F.sum("n").cast("double"))
    kept = a.where("screen_retained").groupBy("source").agg(rate.alias("precision"))
    out = a.where("not screen_retained").groupBy("source").agg(rate.alias("fn_rate"))
    rates = kept.join(out, "source", "full")
    joined = rates.join(population, "source", "left")
    joined = joined.withColumn("est_in_scope", F.col("retained") * F.col("precision")).withColumn("est_missed", F.col("excluded") * F.col("fn_rate"))
    recall = F.try_divide(F.col("est_in_scope"), F.col("est_in_scope") + F.col("est_missed"))
    return joined.select("source", "precision", "fn_rate", "est_in_scope", "est_missed", recall.alias("recall"))
