"""Problem 4: copies that differ only in layout, case, punctuation or the order of their field lines.

Each text is a small tree: the body (key of its lines that are no field lines, in order) and an unordered node of field
lines. Leaves are hashed (BLAKE2b), child digests of the unordered node are sorted, the root digest is made of both nodes.
Rows are counted by root digest; for roots of several rows the trees themselves are fetched, one for all equal ones of a
batch, and grouped in full, so that counts and copies rest on the structure and not on the digest.

Defined results: a null text, an empty one and one without a-z or 0-9 belong to no group. Ties: the smallest id stands
for a group; an id that occurs twice counts as two rows but never pairs with itself. Columns besides id and text are
ignored, whatever their names; an empty table gives an empty result. A null id is a row like any other in counts and
is never a representative unless all ids of its group are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels
from lexiloom.llm.bits import bit_map, map_size, marked
from lexiloom.runtime import cut, spread


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in kernels.slices(whole)):
        root, full, _ = kernels.roots(batch.column("text"))
        kept = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), pa.array(root[kept, 0]), pa.array(root[kept, 1])], ["id", "r1", "r2"])


def hashed(rows: DataFrame) -> DataFrame:
    """(id, r1, r2): root digests of all texts with content."""
    return rows.select("id", "text").mapInArrow(_hashed, "id long, r1 long, r2 long")


def _trees(keep: np.ndarray):
    """(r1, r2, tree, ids): the trees whose root the map `keep` may hold, once for all equal ones of a slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole)):
            root, full, trees = kernels.roots(batch.column("text"))
            ids, own = batch.column("id").to_pylist(), {}
            for i in np.flatnonzero(full & marked(keep, root[:, 0])).tolist():
                own.setdefault((root[i, 0], root[i, 1], trees[i]), []).append(ids[i])
            columns = list(zip(*own)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(list(own.values()), pa.list_(pa.int64()))], ["r1", "r2", "tree", "ids"]
            )

    return run


def _groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids of texts alone with their root; the confirmed groups of the others; the members of these, a row for each slice of a batch."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null"))
    per = cut(hashed(rows).groupBy("r1", "r2").agg(F.min("id").alias("id"), F.count("*").alias("n")), "roots")
    several = per.where("n > 1").select("r1", "r2")
    met = rows.mapInArrow(_trees(bit_map(several, "r1", map_size(several.count()))), "r1 long, r2 long, tree binary, ids array<long>")
    met = cut(met.join(several, ["r1", "r2"]), "trees")
    firsts = met.groupBy("r1", "r2", "tree").agg(F.min(F.array_min("ids")).alias("first_id"), F.sum(F.size("ids")).alias("n"))
    return per.where("n = 1").select("id"), firsts, met


def copies(df: DataFrame, id_col: str = "email_id", text_col: str = "text") -> DataFrame:
    """Rows other than the first of their group: (id, first_id), first_id being the group's smallest id."""
    _, firsts, met = _groups(df, id_col, text_col)
    members = met.join(firsts, ["r1", "r2", "tree"]).select("first_id", F.explode("ids").alias("id"))
    return members.where("id <> first_id").select("id", "first_id").distinct()


def records(df: DataFrame, id_col: str = "email_id", text_col: str = "text") -> DataFrame:
    """One row per distinct record: its smallest id and its number of copies. Texts without content stay out."""
    alone, firsts, _ = _groups(df, id_col, text_col)
    return alone.select(F.col("id").alias(id_col), F.lit(1).cast("long").alias("n_copies")).unionByName(firsts.select(F.col("first_id").alias(id_col), F.col("n").cast("long").alias("n_copies")))
