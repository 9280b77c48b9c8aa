"""Writers of corpora, results and reports (K1-K5, K8). Reports are tables of bounded size; corpora stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as X

# Fixed values.
STATUSES = ["Completed", "Partially completed", "Modified", "Not completed"]


def write_corpus_csv(df: DataFrame, path: str) -> None:
    """text, label, source as quoted CSV with header (K1)."""
    df.select("text", "label", "source").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def results_document(results: DataFrame, best_params: dict[str, dict] | None = None) -> list[dict]:
    """The results of models, one row each, as a document (K2): scores, interval, confusion matrix and tuned parameters by model."""
    shown = ("model", "precision", "recall", "f1", "accuracy", "auc")
    out = []
    for r in results.orderBy("model").collect():  # one row a model
        out.append({k: r[k] for k in shown} | {"f1_ci_low": r["ci_low"], "f1_ci_high": r["ci_high"], "confusion_matrix": [[r["tn"], r["fp"]], [r["fn"], r["tp"]]], "best_params": (best_params or {}).get(r["model"], {})})
    return out


def write_table_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Numbers with a fixed count of decimals, rounded half to even."""
    shown = [F.format_string(f"%.{digits}f", F.bround(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A Markdown table of a report, numbers rounded half to even (K3). All rows come to the driver: reports have few."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def write_snippets(df: DataFrame, path: str, key: str = "key", text: str = "text") -> None:
    """One line a sampled text: key, tab, snippet (K5)."""
    df.select(F.concat_ws("\t", F.col(key).cast("string"), X.snippet(F.col(text))).alias("value")).write.mode("overwrite").text(path)


def alignment(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(objective, status) rows checked against the allowed statuses (K8); ValueError names a status that is not."""
    bad = sorted({s for _, s in rows} - set(STATUSES))
    if bad:
        raise ValueError(f"unknown status: {', '.join(bad)}")
    return spark.createDataFrame(rows, "objective string, status string")


def status_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))
