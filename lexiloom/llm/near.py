"""Problems 1 and 6: texts that are the same or nearly the same, by fingerprints and an exact check.

Rows with equal keys form a class; only one fingerprint per class enters the candidate search, so a text that a third
of all rows repeat costs no more than one that occurs once. Classes are expanded to rows at the very end.

Defined results: null and empty texts and texts without a-z or 0-9 are never cases. Repeated rows form one class. Ties
do not arise, since all pairs at or above the threshold are kept. Extra columns are ignored. Empty input, empty output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.minima import estimate, unequal
from lexiloom.llm import kernels
from lexiloom.operators.graph import components
from lexiloom.runtime import cut, discard, spread


def split_name(split: Column) -> Column:
    """train, val, test or another name in lower case without spaces around; null stays null."""
    s = F.lower(F.trim(split))
    return F.when(s == "validation", "val").otherwise(s)


# -- similarity-hash fingerprints across splits ---------------------------------------------------------------------


def apart_share(least: float) -> float:
    """Share of bits in which SimHash fingerprints of two sets with Jaccard similarity `least` differ on average: their angle."""
    return math.acos(2 * least / (1 + least)) / math.pi


def block_shape(n: int, least: float = 0.8) -> tuple[int, int]:
    """Bits of a block and number of blocks for n texts.

    Blocks of different texts meet by chance n * n / 2**bits times, so bits grow a little faster than log2(n). Blocks are as
    many as keep the expected number that a pair at `least` shares at 4.6, so that 99 of 100 such pairs share one.
    """
    bits = max(8, round(1.15 * math.log2(max(n, 2)) - 4))
    return bits, math.ceil(4.6 / (1 - apart_share(least)) ** bits)


def most_apart(bits: int, least: float, deviations: float) -> int:
    """Differing bits of `bits` that a pair at `least` passes only by so many standard deviations."""
    p = apart_share(least)
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _fingerprints(longs: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole)):
            digits, offs = kernels.keys(batch.column("text"))
            kept = np.flatnonzero(np.diff(offs) > 0)
            codes, counts = kernels.pieces(digits, offs)
            digest = kernels.digests(digits, offs)[kept]
            codes, counts = kernels.distinct(codes, counts)  # as the similarity counts them: a repeated passage turns nothing
            packed = kernels.simhash(kernels.mixed(codes), counts, longs * 64, seed)[kept].view(np.int64)
            prints = pa.ListArray.from_arrays(np.arange(0, packed.size + 1, longs, dtype=np.int32), packed.ravel())
            out = batch.drop_columns(["text"]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(digest[:, 0]), pa.array(digest[:, 1]), prints], [*out.schema.names, "k1", "k2", "print"])

    return run


def blocks_of(prints: Column, bits: int, blocks: int) -> Column:
    """The blocks of a fingerprint (array of longs), each with its number above its bits."""
    made = []
    for i in range(blocks):
        j, at = divmod(i * bits, 64)
        own = F.shiftrightunsigned(prints[j], at)
        if at + bits > 64:
            own = own.bitwiseOR(F.shiftleft(prints[j + 1], 64 - at))
        made.append(own.bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(i << bits))
    return F.array(*made)


def hamming(x: Column, y: Column, longs: int) -> Column:
    """Number of bits in which two fingerprints (arrays of longs) differ."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(longs)), F.lit(0))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, ...) of ids whose texts have a similarity of at least `least`, computed exactly; adds `similarity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole, "ta")):
            j = kernels.jaccard(batch.column("ta"), batch.column("tb"))
            kept = pa.array(np.flatnonzero(j >= least))
            out = batch.drop_columns(["ta", "tb"]).take(kept)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(j).take(kept)], [*out.schema.names, "similarity"])

    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    full = full.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema if f.name not in ("ta", "tb"))
    return full.mapInArrow(run, f"{fields}, similarity double")


def _cross(df: DataFrame, columns: list[str], id_col: str, text_col: str, split_col: str, least: float, deviations: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Linked classes (a, b, similarity), a with train rows and b with val or test rows, and members (id, side, columns, class)."""
    bits, blocks = block_shape(df.count(), least)
    longs = max(2, -(-blocks * bits // 64))
    side = split_name(F.col(split_col))
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), *columns, F.col(text_col).alias("text"), side.alias("side")).where("side in ('train', 'val', 'test') and text is not null"))
    own = [f for f in rows.schema if f.name != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    train, held = F.col("side") == "train", F.col("side") != "train"
    per_side = cut(rows.select(*[f"`{f.name}`" for f in own], "text").mapInArrow(_fingerprints(longs, seed), f"{fields}, k1 long, k2 long, print array<long>"), "prints")
    # the fingerprint is a function of the key, so any value of a class is its value
    classes = cut(per_side.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.max(train).alias("trains"), F.max(held).alias("holds"), F.first("print").alias("print")), "classes")
    posted = classes.select("class", F.col("print")[0].alias("code"), F.col("print")[1].alias("more"), "trains", "holds", F.explode(blocks_of(F.col("print"), bits, blocks)).alias("block"))
    t = posted.where("trains").select("block", F.col("class").alias("a"), F.col("code").alias("code_a"), F.col("more").alias("more_a"))
    e = posted.where("holds").select("block", F.col("class").alias("b"), F.col("code").alias("code_b"), F.col("more").alias("more_b"))
    apart = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) + F.bit_count(F.col("more_a").bitwiseXOR(F.col("more_b")))
    close = t.join(e, "block").where((F.col("a") != F.col("b")) & (apart <= most_apart(128, least, deviations)))
    near = close.select("a", "b").distinct()
    wide = classes.select("class", "print")
    near = near.join(wide.select(F.col("class").alias("a"), F.col("print").alias("pa")), "a").join(wide.select(F.col("class").alias("b"), F.col("print").alias("pb")), "b")
    near = cut(near.where(hamming(F.col("pa"), F.col("pb"), longs) <= most_apart(longs * 64, least, deviations)).select("a", "b"), "near", classes.count() * blocks * 40)
    equal = classes.where("trains and holds").select(F.col("class").alias("b"), F.col("class").alias("a"), F.lit(1.0).alias("similarity"))
    linked = _verified(near, rows.select("id", "text"), least).unionByName(equal)
    return linked, per_side.drop("print").join(classes.select("k1", "k2", "class"), ["k1", "k2"]).drop("k1", "k2")


def cross_split_pairs(df: DataFrame, id_col: str = "email_id", text_col: str = "text", split_col: str = "split", least: float = 0.8, deviations: float = 4.6, seed: int = 11) -> DataFrame:
    """All pairs (train_id, eval_id, eval_split, similarity) of a train row and a val or test row at or above `least`.

    A SimHash is cut into blocks (block_shape). Classes of the two sides that share a block are candidates if they differ in
    no more of the first 128 bits, and then of all bits, than a pair at `least` does with `deviations` standard deviations to
    spare; their texts are compared exactly.
    """
    linked, member = _cross(df, [], id_col, text_col, split_col, least, deviations, seed)
    out = linked.join(member.where("side = 'train'").select(F.col("class").alias("a"), F.col("id").alias("train_id")), "a")
    out = out.join(member.where("side <> 'train'").select(F.col("class").alias("b"), F.col("id").alias("eval_id"), F.col("side").alias("eval_split")), "b")
    return out.select("train_id", "eval_id", "eval_split", "similarity")


def overlap_counts(df: DataFrame, id_col: str = "email_id", text_col: str = "text", split_col: str = "split", source_col: str = "source", least: float = 0.8, deviations: float = 4.6, seed: int = 11) -> DataFrame:
    """(split, source, n_rows, n_pairs): per split and source of val and test rows, how many stand in train too and in how many pairs.

    Counted from the sizes of classes: no pair of rows is made, however many copies a text has.
    """
    linked, member = _cross(df, [F.col(source_col).alias("source")], id_col, text_col, split_col, least, deviations, seed)
    member = cut(member, "members")
    trains = member.where("side = 'train'").groupBy(F.col("class").alias("a")).agg(F.count("*").alias("n"))
    per = linked.join(trains, "a").groupBy("b").agg(F.sum("n").alias("pairs"))
    held = member.where("side <> 'train'").groupBy(F.col("class").alias("b"), F.col("side").alias("split"), "source").agg(F.count("*").alias("rows"))
    return held.join(per, "b").groupBy("split", "source").agg(F.sum("rows").alias("n_rows"), F.sum(F.col("rows") * F.col("pairs")).alias("n_pairs"))


# -- b-bit minwise signatures ---------------------------------------------------------------------------------------


def _signatures(bands: int, width: int, wide: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Band hashes, the 2-bit signature that travels with them (96 minima that no band uses) and a longer one (wide minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole)):
            digits, offs = kernels.keys(batch.column("text"))
            kept = np.flatnonzero(np.diff(offs) > 0)
            codes, counts = kernels.pieces(digits, offs)
            digest = kernels.digests(digits, offs)[kept]
            m = kernels.minima(kernels.mixed(codes), counts, None, 96 + max(bands * width, wide), seed)[kept]
            sig, m = kernels.low_bits(m[:, :96]), m[:, 96:]
            more = kernels.low_bits(m[:, :wide])
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            out = batch.drop_columns(["text"]).take(pa.array(kept))
            root = kernels.roots(batch.column("text"))[0][kept]
            names = [*out.schema.names, "r1", "r2", "k1", "k2", "s1", "s2", "s3", "more", "bands"]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(root[:, 0]), pa.array(root[:, 1]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *(pa.array(sig[:, i].copy()) for i in range(3)), lists(more), lists(kernels.band_keys(m, bands, width))], names)

    return run


def band_shape(n: int) -> tuple[int, int]:
    """Number of bands and minima in each for n texts.

    Texts with a background similarity of about 0.2 meet by chance in proportion to n * n * 0.2**width, so the width grows
    by one for each ten times the texts above 2**18; bands are doubled with it, which keeps the chance that a pair at 0.5
    shares one at 0.998.
    """
    width = 3 + max(0, math.ceil(math.log10(max(n, 1) / 2**18)))
    return 48 << (width - 3), width


def near_classes(
    rows: DataFrame, least: float = 0.5, wide: int = 128, slack: float = 0.24, slack_all: float = 0.156, seed: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal keys and the similar pairs among them, for rows (id, text, ...).

    Returns members (row columns without text, record digest r1, r2, class) and pairs (a, b, similarity) of classes with a < b. All pieces
    weigh the same, so that minima agree as often as the true similarity says, whatever share of the corpus holds a piece:
    a pair at 0.5 shares a band with a chance of 0.998. Pairs sharing a band are candidates if the estimate from 96
    two-bit minima is at most `slack` below `least` and that from all 96 + wide ones at most `slack_all`, 3.5 and 3.6
    standard deviations or more; then the texts are compared exactly. Bands follow from the number of rows (band_shape).
    """
    bands, width = band_shape(rows.count())
    rows = spread(rows.where("text is not null"))
    kept = [f for f in rows.schema if f.name != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    signed = cut(rows.select(*[f.name for f in kept], "text").mapInArrow(_signatures(bands, width, wide, seed), f"{fields}, r1 long, r2 long, k1 long, k2 long, s1 long, s2 long, s3 long, more array<long>, bands array<int>"), "signed")
    classes = cut(signed.groupBy("k1", "k2").agg(F.min("id").alias("class"), *[F.first(c).alias(c) for c in ("s1", "s2", "s3", "more", "bands")]), "classes")
    members = cut(signed.select(*[f.name for f in kept], "r1", "r2", "k1", "k2"), "members")
    discard(rows.sparkSession, signed)
    size = classes.count() * bands * 48
    posted = classes.select("class", "s1", "s2", "s3", F.posexplode("bands").alias("at", "own")).select("class", "s1", "s2", "s3", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("own").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("band"))
    left, right = (posted.select("band", F.col("class").alias(x), *[F.col(f"s{i}").alias(f"{x}{i}") for i in (1, 2, 3)]) for x in "ab")
    apart = sum((unequal(F.col(f"a{i}"), F.col(f"b{i}")) for i in (1, 2, 3)), F.lit(0))
    near = left.join(right, "band").where((F.col("a") < F.col("b")) & (estimate(apart, 96) >= least - slack))
    near = near.select("a", "b", apart.alias("apart")).dropDuplicates(["a", "b"])
    wider = classes.select("class", "more")
    near = near.join(wider.select(F.col("class").alias("a"), F.col("more").alias("ma")), "a").join(wider.select(F.col("class").alias("b"), F.col("more").alias("mb")), "b")
    for i in range(wide // 32):
        near = near.withColumn("apart", F.col("apart") + unequal(F.col("ma")[i], F.col("mb")[i]))
    near = cut(near.where(estimate(F.col("apart"), 96 + wide) >= least - slack_all).select("a", "b"), "near", size)
    pairs = _verified(near, rows.select("id", "text"), least)
    members = members.join(classes.select("k1", "k2", "class"), ["k1", "k2"]).drop("k1", "k2")
    return members, pairs.select("a", "b", "similarity")


def near_duplicate_pairs(df: DataFrame, id_col: str = "email_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All pairs (a, b) of ids, a < b, with a similarity of at least `least` that are not copies of each other (records)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, pairs = near_classes(rows, least)
    members = cut(members.select("id", F.struct("r1", "r2").alias("root"), "class"), "members")
    nodes = members.select("class", "root").distinct()  # rows of a node are copies of each other
    several = nodes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    inner = several.select(F.col("class").alias("a"), F.col("class").alias("b"))
    linked = pairs.select("a", "b").unionByName(inner)
    of = lambda x: nodes.select(F.col("class").alias(x), F.col("root").alias(f"root_{x}"))
    linked = linked.join(of("a"), "a").join(of("b"), "b").where((F.col("root_a") != F.col("root_b")) & ((F.col("a") != F.col("b")) | (F.col("root_a") < F.col("root_b"))))
    rows_of = lambda x: members.select(F.col("class").alias(x), F.col("root").alias(f"root_{x}"), F.col("id").alias(f"id_{x}"))
    out = linked.join(rows_of("a"), ["a", "root_a"]).join(rows_of("b"), ["b", "root_b"])
    return out.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str = "email_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, group, n_links): the group of every row, named by its smallest id, and how many other texts its text is linked to.

    Groups are chains of similar texts and of copies in the sense of records. A row without a key is a group of its own.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, pairs = near_classes(rows, least)
    members, pairs = cut(members, "members"), cut(pairs.select("a", "b"), "pairs")
    nodes = members.select("class", "r1", "r2").distinct()
    same = nodes.groupBy("r1", "r2").agg(F.min("class").alias("a"))
    copies = nodes.join(same, ["r1", "r2"]).where("a <> class").select("a", F.col("class").alias("b"))
    found = components(pairs.unionByName(copies), "a", "b").select(F.col("node").alias("class"), "component")
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("class")).agg(F.count("*").alias("links"))
    own = members.select("id", "class").distinct().join(found, "class", "left").join(links, "class", "left")
    own = own.select("id", F.coalesce("component", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("n_links"))
    out = rows.select("id").join(own, "id", "left")
    return out.select("id", F.coalesce("group", "id").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
