"""Seeded orders and exact ranks that need no single-task sort.

Rows are ordered by md5(seed:key), which any SQL engine computes alike. A rank inside a group comes from two levels: counts
per hash range are added up, one row per range, and only rows of one range are sorted together. A group may hold any share
of all rows.

Defined results: equal keys are ordered by the key and then arbitrarily among identical ones; null keys rank by the hash of
the seed alone. Helper columns begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import lexicons

RANGES = 4096


def order_hash(key: Column, seed: int = lexicons.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def ranked(df: DataFrame, groups: list[str], key: str, seed: int = lexicons.SEED, rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with the 1-based rank of each row in its group by order_hash, and optionally the size of the group.

    Columns of df that have the names of the new ones are replaced.
    """
    rows = df.withColumn("__hash", order_hash(F.col(key), seed)).withColumn("__range", F.substring("__hash", 1, 3))
    by = [F.col(g) for g in groups] or [F.lit(0)]
    counts = rows.groupBy(*[b.alias(f"__g{i}") for i, b in enumerate(by)], F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    names = [f"__g{i}" for i in range(len(by))]
    ahead = Window.partitionBy(*names).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).withColumn("__size", F.sum("__n").over(Window.partitionBy(*names)))
    match = F.col("__range") == F.col("__r")
    for b, name in zip(by, names):
        match &= b.eqNullSafe(F.col(name))
    out = rows.join(counts, match).withColumn(rank, F.col("__before") + F.row_number().over(Window.partitionBy(*names, "__range").orderBy("__hash", key)))
    if size:
        out = out.withColumn(size, F.col("__size"))
    new = [rank, *([size] if size else [])]
    return out.select(*[c for c in df.columns if c not in new], *new)


def first_per_group(df: DataFrame, groups: list[str], key: str, k: int, seed: int = lexicons.SEED) -> DataFrame:
    """The k first rows of each group in hash order; only hash ranges that can hold them are sorted."""
    return ranked(df, groups, key, seed).where(F.col("rank") <= k)  # adds rank


def downsampled(df: DataFrame, label: str, key: str, seed: int = lexicons.SEED) -> DataFrame:
    """Every class cut to the size of the smallest, first rows in hash order."""
    out = ranked(df, [label], key, seed, rank="__rank", size="__of")
    least = df.groupBy(label).agg(F.count("*").alias("__c")).agg(F.min("__c").alias("__least"))
    return out.crossJoin(F.broadcast(least)).where(F.col("__rank") <= F.col("__least")).select(*df.columns)  # one row


def split_of(rank: Column, size: Column, test: float = lexicons.TEST_SHARE, val: float = lexicons.VAL_SHARE) -> Column:
    n_test, n_val = F.bround(size * F.lit(test)), F.bround(size * F.lit(val))
    return F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")


def stratified_split(df: DataFrame, label: str, key: str, test: float = lexicons.TEST_SHARE, val: float = lexicons.VAL_SHARE, seed: int = lexicons.SEED) -> DataFrame:
    """df with `split`: per class the first round(test*n) rows in hash order are test, the next round(val*n) val, the rest train."""
    out = ranked(df, [label], key, seed, rank="__rank", size="__of")
    return out.withColumn("split", split_of(F.col("__rank"), F.col("__of"), test, val)).select(*[c for c in df.columns if c != "split"], "split")


def folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """df with `fold` 0..k-1, dealt per class in hash order so that each fold has the class shares of the whole."""
    return ranked(df, [label], key, rank="__rank").withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")
