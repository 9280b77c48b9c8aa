"""Registered queries of the subpackage: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import encoding, grouping, leakage, mixing, near, personal, records, residue
from lexiloom.runtime import cut, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near.cross_split_pairs(table(spark, sf_dir, "emails"))
    return pairs.select(F.least("train_id", "eval_id").alias("email_id_a"), F.greatest("train_id", "eval_id").alias("email_id_b"))


def p1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.overlap_counts(table(spark, sf_dir, "emails"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(grouping.tied_sources(table(spark, sf_dir, "emails")), "tied")
    a, b = (found.select("component", F.col("source").alias(f"source_{x}")) for x in "ab")
    return a.join(b, "component").where("source_a < source_b").select("source_a", "source_b")


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.grouped_split(table(spark, sf_dir, "emails")).select(F.col("id").alias("email_id"), "split")


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails").select("email_id", "label")
    split = grouping.grouped_split(table(spark, sf_dir, "emails")).select(F.col("id").alias("email_id"), "split")
    return emails.join(split, "email_id").groupBy("split", "label").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails")
    given = personal.given_names(emails)
    found = personal.found(emails, given)
    return personal.items(found, given=given, model=personal.name_model(found, given))


def p3_pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails")
    given = personal.given_names(emails)
    found = personal.found(emails, given)
    return personal.pseudonymised(found, key="lexiloom", given=given, model=personal.name_model(found, given))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.copies(table(spark, sf_dir, "emails")).where("id <> first_id")
    return rows.select(F.col("first_id").alias("email_id_a"), F.col("id").alias("email_id_b"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(table(spark, sf_dir, "emails"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(spread(table(spark, sf_dir, "emails").select("email_id", "text"))).select("email_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(spread(table(spark, sf_dir, "emails").select("email_id", "text"))).select("email_id", "restored")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near.near_duplicate_pairs(table(spark, sf_dir, "emails"))
    return pairs.select(F.col("id_a").alias("email_id_a"), F.col("id_b").alias("email_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicate_groups(table(spark, sf_dir, "emails")).select(F.col("id").alias("email_id"), "group", "n_links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return selection.select(F.col("id").alias("doc_id"), "source", "copies", "tokens")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"))


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by label and by how they were found: by trusted rules, or only by likeness to trusted residue."""
    found = residue.residue(table(spark, sf_dir, "documents"))
    return found.groupBy("label", F.when(F.col("trusted"), "trusted").otherwise("near").alias("found_by")).agg(F.count("*").alias("n_documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
