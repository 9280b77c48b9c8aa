"""Problem 8: documents of several sources mixed to target shares of tokens.

The total is the largest one at which every source can have its share without passing its cap, at most the tokens of all
targeted sources. Every source gets its share of it. Whole epochs come first: each document as often as the source fits into
its budget. The rest is drawn by Efraimidis-Spirakis keys, -ln(u)/quality with u from the MD5 of the document's id, in
ascending order until the rest of the budget is used up; the document that would pass it is taken if that comes nearer to the
budget than leaving it out. A caller may ask for another total; a source that its cap then holds
below its share is not made up for, and the report shows by how much the shares are missed.

Defined results: sources are compared in the clean spelling; a document of a source without target, and a null source or
text, is not selected; a source without documents has no rows in the selection and zeros in the report, and its share is
dealt to the others in proportion (wanted_share); a null cap is no cap, a cap of 0 excludes its source likewise, a null or negative share is 0; a source named twice in the targets keeps the larger share. Ties between keys go to the
smaller id. Repeated rows are documents of their own. Empty tables give empty selections.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import kernels
from lexiloom.runtime import cut, spread

BUCKETS = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TEXTUAL = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ":
    _TEXTUAL[_c] = True
_TEXTUAL[128:] = True


def clean_source(source: Column) -> Column:
    """Lower case, no spaces around, hyphens for inner spaces and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s_]+|[\s_]+$", ""), r"[\s_]+", "-")


def measured(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, text) rows as (id, source, tokens, quality); quality is 0.1 to 1, by the share of letters and blanks."""

    context = docs.sparkSession.sparkContext
    context.addFile(vocabulary)  # to every executor; only the driver needs the file
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            tokens = [len(coder.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            raw, offs = kernels.text_bytes(batch.column("text"))
            total = np.concatenate([[0], np.cumsum(_TEXTUAL[raw])])
            share = (total[offs[1:]] - total[offs[:-1]]) / np.maximum(1, np.diff(offs))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(tokens, pa.int64()), pa.array(0.1 + 0.9 * share)], ["id", "source", "tokens", "quality"])

    return docs.mapInArrow(run, "id long, source string, tokens long, quality double")


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, wanted_share, documents, available, budget, epochs, rest) of every target."""
    wanted = targets.select(clean_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("w")).select("source", "w.*")
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    joined = wanted.join(have, "source", "left").fillna(0, ["documents", "available"])
    every = Window.partitionBy(F.lit(0))  # one row per target
    usable = (F.col("available") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    share = F.when(usable, F.col("target_share")).otherwise(F.lit(0.0))
    joined = joined.withColumn("wanted_share", F.coalesce(F.try_divide(share * F.sum("target_share").over(every), F.sum(share).over(every)), F.lit(0.0)))
    most = F.col("max_repeats").cast("long") * F.col("available")
    allowed = F.least(F.sum("available").over(every).cast("double"), F.min(F.when(F.col("wanted_share") > 0, most / F.col("wanted_share"))).over(every))
    size = F.lit(float(total)) if total is not None else allowed
    budget = F.least(F.round(F.col("wanted_share") * size).cast("long"), F.coalesce(most, F.lit(2**62)))
    out = joined.withColumn("budget", F.when(usable, budget).otherwise(F.lit(0)))
    out = out.withColumn("epochs", F.coalesce(F.try_divide("budget", "available").cast("long"), F.lit(0)))
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Selection (id, source, copies, tokens) and report (source, target_share, wanted_share, documents, budget, epochs, tokens, actual_share).

    No source is ever sorted in one task: keys fall into BUCKETS ranges of equal chance, token sums of ranges are added up,
    and only the range in which the budget ends is sorted, one of BUCKETS per source.
    """
    rows = docs.select(F.col(id_col).alias("id"), clean_source(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where("text is not null and source is not null")
    sized = cut(measured(spread(rows), vocabulary), "sized")
    plan = cut(budgets(sized, targets, total), "plan")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)
    keyed = sized.join(plan.select("source", "epochs", "rest"), "source").withColumn("key", -F.log(u) / F.col("quality"))
    keyed = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key") * 0.5)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    keyed = keyed.join(sums, ["source", "bucket"])
    inside = F.col("before") + F.col("sum") <= F.col("rest")
    ends = (F.col("before") < F.col("rest")) & ~inside
    order = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    cutting = keyed.where(ends).withColumn("upto", F.col("before") + F.sum("tokens").over(order)).withColumn("more", (2 * F.col("upto") - F.col("tokens") < 2 * F.col("rest")).cast("long")).drop("upto")
    chosen = keyed.where(~ends).withColumn("more", inside.cast("long")).unionByName(cutting)
    selection = chosen.withColumn("copies", F.col("epochs") + F.col("more")).where("copies > 0").select("id", "source", "copies", "tokens")
    used = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    report = plan.join(used, "source", "left").fillna(0, ["tokens"])
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row per target
    report = report.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
    return selection, report.select("source", "target_share", "wanted_share", "documents", "budget", "epochs", "tokens", "actual_share")
