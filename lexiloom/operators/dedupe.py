"""Exact de-duplication that keeps the first row of each key.

The row with the smallest id survives. Aggregation collapses copies before the shuffle, so a key that a third of all rows
share costs one row per task. Rows with a null or blank text are dropped; repeated ids of one key are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X


def keep_first(df: DataFrame, key: Column, id_col: str, within: list[str] = ()) -> DataFrame:
    """The row with the smallest id for each key, separately for each value of `within`."""
    rest = [c for c in df.columns if c not in (id_col, *within)]
    rows = df.withColumn("__key", key).groupBy(*within, "__key").agg(F.min(F.struct(id_col, *rest)).alias("__row"))
    return rows.select(*[F.col(c) if c in within else F.col(f"__row.{c}").alias(c) for c in df.columns])


def loader_dedupe(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Copies by loader form, over all classes; null and blank texts dropped."""
    kept = df.where(F.col(text_col).rlike(f"[^{X.SPACE}]"))
    return keep_first(kept, X.loader_digest(F.col(text_col)), id_col)


def class_dedupe(df: DataFrame, id_col: str, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """Copies by alphanumeric key, inside each class; null texts and labels dropped."""
    kept = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    return keep_first(kept, X.key_digest(F.col(text_col)), id_col, [label_col])


def duplicate_count(df: DataFrame, key: Column) -> DataFrame:
    """One row: n, distinct_keys and duplicates."""
    per = df.groupBy(key.alias("__key")).agg(F.count("*").alias("__n"))
    return per.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.count("*").alias("distinct_keys")).withColumn("duplicates", F.col("n") - F.col("distinct_keys"))
