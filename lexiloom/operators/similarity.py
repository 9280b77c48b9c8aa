"""Exact similarity join of character-piece sets, single-linkage clusters and their statistics.

Texts with equal keys collapse to one representative first. Candidates share a band of minima and pass an estimate from packed
low bits, or, as an exact option, share a prefix of rare pieces; all are verified on the full sets.

Defined results: an empty key is always a singleton; a key shorter than a piece is its own piece; null texts are left out;
an id that occurs twice stands for one member. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.functions import minima as M
from lexiloom.functions import pieces as P
from lexiloom.functions import text as X
from lexiloom.operators.graph import components
from lexiloom.runtime import cut, spread


def representatives(df: DataFrame, id_col: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) of texts with a key, and representatives (rep, key): the smallest id for each key."""
    keyed = spread(df.where(F.col(text_col).isNotNull())).select(F.col(id_col).alias("id"), X.alnum_key(F.col(text_col)).alias("key")).where("key <> ''")
    keyed = cut(keyed.withColumn("digest", F.sha1("key")), "keyed")  # keys are made once, for members and representatives
    reps = cut(keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("key").alias("key")), "reps")
    members = keyed.select("id", "digest").join(reps.select("digest", "rep"), "digest").select("id", "rep").distinct()
    return members, reps.select("rep", "key")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, piece): the distinct pieces of each key and their number."""
    for batch in (part for whole in batches for part in P.slices(whole, "key")):
        codes, counts = P.pieces(*P.keys(batch.column("key")))
        own = np.unique(np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32 | codes)
        row = own >> 32
        n = np.bincount(row, minlength=len(counts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), pa.array(n[row]), pa.array((own & 0xFFFFFFFF).astype(np.int32))], ["rep", "n", "piece"])


def _prefix_candidates(reps: DataFrame, least: float) -> DataFrame:
    """(a, b) of all pairs that may reach `least`: those that share one of the rarest pieces of each, under length and position bounds."""
    posted = cut(reps.mapInArrow(_posted, "rep long, n int, piece int"), "posted")
    frequency = posted.groupBy("piece").agg(F.count("*").alias("df")).where("df > 1")  # a piece of one text joins nothing, but holds the first places
    order = Window.partitionBy("rep").orderBy("df", "piece")  # the pieces of one text
    alone = F.col("n") - F.count("*").over(Window.partitionBy("rep"))
    ranked = posted.join(frequency, "piece").withColumn("position", alone + F.row_number().over(order))
    prefix = ranked.where(F.col("position") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1)
    prefix = cut(prefix.select("piece", "rep", "n", "position"), "prefix")
    left = prefix.select("piece", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("position").alias("pa"))
    right = prefix.select("piece", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("position").alias("pb"))
    # shared pieces up to this one, at most, and after it; every common prefix piece bounds the overlap
    reach = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - 1e-6)
    near = left.join(right, "piece").where((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")) & (reach >= need))
    return near.select("a", "b").distinct()


WIDE = 128  # minima of the bands that the longer signature has besides the 96


def _signed(bands: int, width: int, seed: int):
    """(rep, s1, s2, s3, more, bands): two-bit signature of 96 minima, that of WIDE others, and the band hashes of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in P.slices(whole, "key")):
            codes, counts = P.pieces(*P.keys(batch.column("key")))
            m = M.minima(M.mixed(codes), counts, None, 96 + max(bands * width, WIDE), seed)
            sig, more, keys = M.low_bits(m[:, :96]), M.low_bits(m[:, 96 : 96 + WIDE]), M.band_keys(m[:, 96:], bands, width)
            more, lists = (pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()) for x in (more, keys))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *(pa.array(sig[:, i].copy()) for i in range(3)), more, lists], ["rep", "s1", "s2", "s3", "more", "bands"])

    return run


def _band_candidates(reps: DataFrame, least: float, seed: int = 3) -> DataFrame:
    """(a, b) of pairs that share a band of minima and whose signatures promise `least`: that of 96 minima with
    3.5 standard deviations allowed, then that of all 224 with 3.6.

    A pair at `least` shares a band with a chance of 0.998 or more. Bands get wider with the number of texts, so that chance
    meetings stay in proportion.
    """
    width = 3 + max(0, math.ceil(math.log10(max(reps.count(), 1) / 2**18)))
    bands = math.ceil(math.log(0.002) / math.log(1 - least**width))
    signed = cut(reps.mapInArrow(_signed(bands, width, seed), "rep long, s1 long, s2 long, s3 long, more array<long>, bands array<int>"), "signed")
    posted = signed.select("rep", "s1", "s2", "s3", F.posexplode("bands").alias("at", "band"))
    left, right = (posted.select("at", "band", F.col("rep").alias(x), *[F.col(f"s{i}").alias(f"{x}{i}") for i in (1, 2, 3)]) for x in "ab")
    apart = sum((M.unequal(F.col(f"a{i}"), F.col(f"b{i}")) for i in (1, 2, 3)), F.lit(0))
    slack = lambda n, deviations: deviations * math.sqrt((0.25 + 0.75 * least) * 0.75 * (1 - least) / n) / 0.75
    near = left.join(right, ["at", "band"]).where((F.col("a") < F.col("b")) & (M.estimate(apart, 96) >= least - slack(96, 3.5)))
    near = near.select("a", "b", apart.alias("apart")).distinct()
    for x in "ab":
        near = near.join(signed.select(F.col("rep").alias(x), F.col("more").alias(f"m{x}")), x)
    apart = sum((M.unequal(F.col("ma")[i], F.col("mb")[i]) for i in range(WIDE // 32)), F.col("apart"))
    return near.where(M.estimate(apart, 96 + WIDE) >= least - slack(96 + WIDE, 3.6)).select("a", "b")


def similar_pairs(reps: DataFrame, least: float = lexicons.JACCARD, exact: bool = False) -> DataFrame:
    """(a, b, similarity) of representatives with a < b at or above `least`; no wrong pair, since candidates are compared in full.

    Candidates come from bands of minima, which grows with the corpus and misses a pair at `least` with a chance of 0.002,
    pairs above it less. exact: candidates from prefixes of rare pieces, which misses none; at 0.5 half of every text is its
    prefix, so that this way is for corpora of some thousand texts.
    """
    near = cut((_prefix_candidates if exact else _band_candidates)(reps, least), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in P.slices(whole, "ka")):
            j = P.jaccard(batch.column("ka"), batch.column("kb"))
            kept = pa.array(np.flatnonzero(j >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept), pa.array(j).take(kept)], ["a", "b", "similarity"])

    full = near.join(reps.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a").join(reps.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b")
    return full.mapInArrow(verify, "a long, b long, similarity double")


def clusters(df: DataFrame, id_col: str, text_col: str = "text", least: float = lexicons.JACCARD) -> DataFrame:
    """(id, cluster) of every row with a text; the cluster is named by its smallest id."""
    members, reps = representatives(df, id_col, text_col)
    members = cut(members, "members")
    linked = components(cut(similar_pairs(reps, least).select("a", "b"), "pairs"), "a", "b")  # read in both directions, compared once
    named = members.join(linked, members.rep == linked.node, "left").select("id", F.coalesce("component", "rep").alias("cluster"))
    rest = df.where(F.col(text_col).isNotNull() & (X.alnum_key(F.col(text_col)) == "")).select(F.col(id_col).alias("id"), F.col(id_col).alias("cluster")).distinct()
    return named.unionByName(rest)


def cluster_stats(found: DataFrame) -> DataFrame:
    """One row: members, clusters, singletons, size of the largest cluster, members of clusters of two and more."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.agg(
        zero(F.sum("n")).alias("n_members"), F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"),
        zero(F.max("n")).alias("largest"), zero(F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("n_in_multi"),
    )


def grouped_split(df: DataFrame, id_col: str, label_col: str, found: DataFrame, test: float = lexicons.TEST_SHARE, val: float = lexicons.VAL_SHARE, seed: int = lexicons.SEED) -> DataFrame:
    """(id, cluster, class, split) that never parts a cluster.

    A cluster's class is the half-even rounded mean of its labels. Per class, clusters in hash order go to test until at
    least round(test*n) members are taken, then to val likewise, the rest to train.
    """
    from lexiloom.operators.ranking import order_hash

    rows = df.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).join(found, "id")
    rows = cut(rows, "rows")  # read three times below; making them may mean keys of all texts
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.bround(F.avg("label")).cast("int").alias("class"))
    sizes = sizes.withColumn("hash", order_hash(F.col("cluster"), seed)).withColumn("range", F.substring("hash", 1, 3))
    ranges = sizes.groupBy("class", "range").agg(F.sum("n").alias("m"))
    ahead = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a class
    ranges = ranges.select("class", "range", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"), F.sum("m").over(Window.partitionBy("class")).alias("total"))
    inside = Window.partitionBy("class", "range").orderBy("hash", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(ranges, ["class", "range"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    n_test, n_val = F.bround(F.col("total") * F.lit(test)), F.bround(F.col("total") * F.lit(val))
    split = F.when(F.col("before") < n_test, "test").otherwise(F.lit(None))
    placed = placed.withColumn("split", split)
    first_val = placed.where(F.col("split").isNull()).groupBy("class").agg(F.min("before").alias("start"))
    placed = placed.join(F.broadcast(first_val), "class", "left")  # one row a class
    placed = placed.withColumn("split", F.coalesce("split", F.when(F.col("before") - F.col("start") < n_val, "val").otherwise("train")))
    return rows.select("id", "cluster").join(placed.select("cluster", "class", "split"), "cluster").select("id", "cluster", "class", "split")


def leakage(assigned: DataFrame) -> DataFrame:
    """Clusters that stand in train and in val or test; none if the split is grouped."""
    per = assigned.groupBy("cluster").agg(F.max(F.col("split") == "train").alias("trains"), F.max(F.col("split") != "train").alias("holds"))
    return per.where("trains and holds").select("cluster")
