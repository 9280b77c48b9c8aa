"""Problem 7: passages of evaluation items inside a corpus.

A leak is a window of `least` consecutive words of an item that stands in a document. A window holds least-4 shingles of
five words. Shingles are ordered by rarity in the corpus; the rarest of each window is its prefix, which every document
with the window must hold. Documents are joined on prefixes only, positions bound the window inside the document, and the
candidates' texts are compared word by word over windows of the item.

Defined results: items of fewer than `least` words never leak; null and empty texts hold nothing; an id that occurs twice
is judged by each of its rows and reported once; ties in rarity go to the first shingle. Extra columns are ignored. Empty
tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import kernels, words
from lexiloom.llm.bits import bit_map, map_size, marked
from lexiloom.runtime import cut, spread

K = 5


def _posted(keep: np.ndarray | None = None):
    """(id, h, pos, n): shingles of (id, text) rows with their position and the text's number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole)):
            h, pos, per = words.shingles(*words.hashed_words(batch.column("text")), K)
            row = np.repeat(np.arange(len(per)), per)
            if keep is not None:
                hit = marked(keep, h.view(np.int64))
                h, pos, row = h[hit], pos[hit], row[hit]
            ids = batch.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array(pos), pa.array(per[row].astype(np.int32))], ["id", "h", "pos", "n"])

    return run


def _windows(said: list[str], least: int) -> set[tuple[str, ...]]:
    return {tuple(said[i : i + least]) for i in range(len(said) - least + 1)}


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least `least` consecutive words of the item; least is 5 or more."""
    schema = "id long, h long, pos int, n int"
    form = lambda df, i: df.where(F.col(text_col).isNotNull()).select(F.col(i).alias("id"), words.match_form(F.col(text_col)).alias("text"))
    held, corpus = form(items, item_id), spread(form(docs, doc_id))
    wanted = cut(held.mapInArrow(_posted(), schema).where(F.col("n") >= least - K + 1).distinct(), "wanted")
    keep = bit_map(wanted, "h", map_size(wanted.count()))
    found = cut(corpus.mapInArrow(_posted(keep), schema), "found")
    rarity = found.groupBy("h").agg(F.count("*").alias("docs"))
    ranked = wanted.join(rarity, "h", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    window = Window.partitionBy("id").orderBy("pos").rowsBetween(0, least - K)
    prefix = ranked.select("id", "pos", "n", F.min(F.struct("docs", "pos", "h")).over(window).alias("first")).where(F.col("pos") <= F.col("n") - (least - K + 1))
    prefix = prefix.where("first.docs > 0").groupBy(F.col("id").alias("item"), F.col("first.h").alias("h"), F.col("first.pos").alias("item_pos")).agg(F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"))
    # the first and the last place of the item where a window may begin so that it lies wholly inside the document
    shift = F.col("item_pos") - F.col("pos")
    near = found.join(prefix, "h").where(F.greatest(F.col("from_pos"), shift) <= F.least(F.col("to_pos"), shift + F.col("n") - (least - K + 1)))
    pairs = cut(near.select(F.col("id").alias("doc"), "item").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile("[a-z0-9]+")
        of_item = lru_cache(1000)(lambda q: _windows(run.findall(q), least))  # an item's windows are built once
        for batch in batches:
            last, said, kept = None, [], []
            for i, (d, q) in enumerate(zip(batch.column("doc_text").to_pylist(), batch.column("item_text").to_pylist())):
                if d is not last and d != last:
                    last, said = d, run.findall(d)
                wanted_ = of_item(q)
                if any(tuple(said[j : j + least]) in wanted_ for j in range(len(said) - least + 1)):
                    kept.append(i)
            yield batch.select(["doc", "item"]).take(pa.array(kept, pa.int32()))

    full = pairs.join(held.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    full = full.join(corpus.select(F.col("id").alias("doc"), F.col("text").alias("doc_text")), "doc")
    sure = full.select("doc", "item", "doc_text", "item_text").mapInArrow(verify, "doc long, item long").distinct()
    return sure.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
