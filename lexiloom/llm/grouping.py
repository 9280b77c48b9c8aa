"""Problem 2: splits that never part rows sharing an author, a source or a case reference.

Defined results: a null source, a sender without an address and a text without reference tie nothing; a row without
any of the three is a group of its own. Labels other than 0 and 1, null included, are one further class. Empty table,
empty result. Repeated rows and ids share all entities, hence the split. Ties between splits that lack the same go to
the first of train, validation, test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import lexicons
from lexiloom.operators.graph import components
from lexiloom.operators.ranking import order_hash
from lexiloom.runtime import cut

SPLITS = ("train", "validation", "test")
_GAP = r"[\s\u00a0.#:]"
_SHAPE = r"[A-Za-z]{2}(?:-|[\s\u00a0]{0,3})[0-9]{6}"
#: Two letters and six digits directly after a whole word that announces a case. The shape is rare, so it is tried first.
REFERENCE = (
    rf"({_SHAPE})(?![\p{{L}}\p{{N}}])(?<=(?<![\p{{L}}\p{{N}}_])(?i:case|ticket|ref|reference|dossier|vorgang|expediente){_GAP}{{1,8}}(?:(?i:no){_GAP}{{1,8}})?{_SHAPE})"
)


def author(sender: Column) -> Column:
    """The address inside a sender, in lower case; null if there is none."""
    found = F.regexp_extract(F.lower(sender), r"[^\s<>\"'(),;]+@[^\s<>\"'(),;]+", 0)
    return F.when(found != "", found)


def case_references(text: Column) -> Column:
    """Distinct case references of a text in the form AB123456."""
    shown = F.translate(F.regexp_replace(text, f"[{lexicons.INVISIBLE}]", ""), lexicons.LOOKALIKE_FROM, lexicons.LOOKALIKE_TO)
    folded = F.when(text.rlike(lexicons.FOLD_HINT), shown).otherwise(text)
    found = F.regexp_extract_all(folded, F.lit(REFERENCE), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))), F.array().cast("array<string>"))


def entities(df: DataFrame, id_col: str, text_col: str, source_col: str, sender_col: str) -> DataFrame:
    """(id, source, names): the entities of each row, prefixed by their kind."""
    kinds = [F.concat(F.lit("s:"), F.col(source_col)), F.concat(F.lit("a:"), author(F.col(sender_col)))]
    refs = F.transform(case_references(F.col(text_col)), lambda x: F.concat(F.lit("r:"), x))
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.concat(F.filter(F.array(*kinds), lambda x: x.isNotNull()), refs).alias("names"))


def entity_components(rows: DataFrame) -> DataFrame:
    """(name, component): entities tied directly or through a chain of rows.

    Rows with the same entities are one record node of the bipartite graph, and a record's smallest entity stands for it
    on its side, so the propagation runs over distinct ties only, however many rows repeat them.
    """
    ties = rows.where(F.size("names") > 0).select(F.array_min("names").alias("record"), F.explode("names").alias("name")).distinct()
    found = components(ties, "record", "name")
    return found.select(F.col("node").alias("name"), "component")


def tied_sources(df: DataFrame, id_col: str = "email_id", text_col: str = "text", source_col: str = "source", sender_col: str = "sender") -> DataFrame:
    """(source, component) of every source."""
    found = entity_components(entities(df, id_col, text_col, source_col, sender_col))
    return found.where(F.col("name").startswith("s:")).select(F.substring("name", 3, 1 << 30).alias("source"), "component")


def grouped_split(
    df: DataFrame, id_col: str = "email_id", text_col: str = "text", source_col: str = "source", sender_col: str = "sender", label_col: str = "label",
    shares: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42,
) -> DataFrame:
    """(id, component, split) of every row.

    Components are strata of their majority label and of their size to the power of two. Inside a stratum they stand in the
    order of md5(seed:name), each at the middle of its rows' share of the stratum. Strata are dealt from the largest sizes to
    the smallest: a split gets the part of a stratum that it still lacks of that label, the one that lacks most the first
    part, and what it really got is added up before the next size is dealt. So the many small components even out what the
    few large ones left, and no component is treated by another rule than the rest.
    """
    extra = df.withColumn("__label", F.coalesce(F.col(label_col).cast("int"), F.lit(-1)))
    rows = entities(extra, id_col, text_col, source_col, sender_col)
    labels = extra.select(F.when(F.col("__label").isin(0, 1), F.col("__label")).otherwise(-1).alias("label"), F.col(id_col).alias("id"))
    rows = cut(rows.select("id", F.coalesce(F.array_min("names"), F.concat(F.lit("i:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("first"), "names"), "entities")
    found = entity_components(rows)
    placed = rows.select("id", "first").join(found.select(F.col("name").alias("first"), "component"), "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    placed = cut(placed, "placed")
    classes = labels.groupBy("id").agg(F.max("label").alias("label"))
    kinds = ("zeros", "ones", "others")
    sizes = placed.join(classes, placed.id.eqNullSafe(classes.id)).groupBy("component").agg(*[F.count_if(F.col("label") == v).alias(k) for v, k in zip((0, 1, -1), kinds)])
    sizes = sizes.withColumn("n", F.expr("zeros + ones + others")).withColumn("power", F.floor(F.log2("n") + 1e-9).cast("int"))
    sizes = sizes.withColumn("kind", F.expr("case when zeros >= ones and zeros >= others then 'zeros' when ones >= others then 'ones' else 'others' end"))
    sizes = cut(_positions(sizes, seed), "sizes")
    strata = sizes.groupBy("power").agg(*[F.sum(k).alias(k) for k in kinds]).orderBy(F.desc("power")).collect()  # one row for each power of two
    want = {s: {k: share * sum(r[k] for r in strata) for k in kinds} for s, share in zip(SPLITS, shares)}
    have = {s: dict.fromkeys(kinds, 0) for s in SPLITS}
    split = F.lit(None).cast("string")
    for r in strata:
        own = F.lit(None).cast("string")
        for k in kinds:
            lack = {s: max(0.0, want[s][k] - have[s][k]) for s in SPLITS}
            whole = sum(lack.values())
            chance = {s: lack[s] / whole if whole else share for s, share in zip(SPLITS, shares)}
            order = sorted(SPLITS, key=lambda s: (-chance[s], SPLITS.index(s)))
            drawn = F.when(F.col("position") < chance[order[0]], order[0]).when(F.col("position") < chance[order[0]] + chance[order[1]], order[1]).otherwise(order[2])
            own = F.when(F.col("kind") == k, drawn).otherwise(own)
        split = F.when(F.col("power") == r["power"], own).otherwise(split)
        for got in sizes.where(F.col("power") == r["power"]).groupBy(own.alias("split")).agg(*[F.sum(k).alias(k) for k in kinds]).collect():  # one row a split
            have[got["split"]] = {k: have[got["split"]][k] + got[k] for k in kinds}
    return placed.join(sizes.select("component", split.alias("split")), "component").select("id", "component", "split")


def _positions(sizes: DataFrame, seed: int) -> DataFrame:
    """Adds the position of each component in its stratum: 0 to 1, by rows, at the middle of its own. Hash ranges are added up first."""
    rows = sizes.withColumn("hash", order_hash(F.col("component"), seed)).withColumn("range", F.substring("hash", 1, 3))
    stratum = ["power", "kind"]
    ranges = rows.groupBy(*stratum, "range").agg(F.sum("n").alias("own"))
    ahead = Window.partitionBy(*stratum).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a stratum
    ranges = ranges.select(*stratum, "range", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("ahead"), F.sum("own").over(Window.partitionBy(*stratum)).alias("total"))
    inside = Window.partitionBy(*stratum, "range").orderBy("hash", "component").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return rows.join(ranges, [*stratum, "range"]).withColumn("position", (before + F.col("n") / 2) / F.col("total")).drop("hash", "range", "ahead", "total")
