"""Connected components by minimum-label propagation with label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.runtime import cut, discard


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component's name is its smallest node.

    Each round a node takes the smallest label among its neighbours and itself, then the label of that label, so chains
    close in few rounds. Both steps aggregate before they shuffle; edges are partitioned by both ends, and the join on one
    end is split by adaptive execution where a hub holds too many. Every round ends in a table in the shared folder.
    Defined results: edges with a null end are ignored, self-loops name a singleton, repeated edges count once, no edges
    give no rows.
    """
    spark = edges.sparkSession
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.v, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "label")
        step = cut(step, "labels")
        changed = step.where("new <> label").limit(1).count()
        discard(spark, labels)
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
