"""Consistency checks as one report (§2.11, A17): every check is a one-row data frame (check, grp, value, pass)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, group: str, value: Column, ok: Column) -> DataFrame:
    """One row from an aggregate over df; `ok` may use the aggregate as column `value`. A null outcome is a failure."""
    return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("value")).select(F.lit(name).alias("check"), F.lit(group).alias("grp"), "value", F.coalesce(ok, F.lit(False)).alias("pass"))


def none_of(df: DataFrame, name: str, group: str) -> DataFrame:
    """Passes if df has no rows."""
    return check(df, name, group, F.count("*"), F.col("value") == 0)


def differing(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """Rows of a full join of two tables that are in one only, or whose values differ by more than the tolerance.

    Null equals null, and nothing else. Keys are not null and name one row each.
    """
    a = left.select(*on, *[F.col(c).cast("double").alias(f"__a_{c}") for c in columns], F.lit(True).alias("__left"))
    b = right.select(*on, *[F.col(c).cast("double").alias(f"__b_{c}") for c in columns], F.lit(True).alias("__right"))
    apart = F.col("__left").isNull() | F.col("__right").isNull()
    for c in columns:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        apart |= ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
    return a.join(b, on, "full").where(apart).select(*on)


def wrong_digests(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(name) of stored (name, sha256) rows whose file is there with another digest; files that are absent cannot be verified and pass."""
    names = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("__now"))
    return stored.join(names, "name").where("sha256 <> __now").select("name")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(found: DataFrame) -> DataFrame:
    """Per group and in total (grp null): checks, passed, failed."""
    return found.rollup("grp").agg(F.count("*").alias("checks"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"))
