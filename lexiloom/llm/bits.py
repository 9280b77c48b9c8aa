"""Bit maps of fixed size over hashed values: what they hold by chance costs a row later on, never a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_P = np.uint64(0x9E3779B97F4A7C15)


def _cells(values: np.ndarray, size: int) -> np.ndarray:
    return ((values.astype(np.int64).view(np.uint64) * _P) >> np.uint64(64 - size)).astype(np.int64)


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the map may hold; every value that went into it is among them."""
    cell = _cells(values, int(len(bits) * 8).bit_length() - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def map_size(n: int) -> int:
    """Logarithm of the size of a map for n values: 16 cells or more for each up to 2**28 cells (32 MB), 2**20 at least."""
    return min(28, max(20, int(n).bit_length() + 4))


def bit_map(df: DataFrame, column: str, size: int, tasks: int = 4) -> np.ndarray:
    """The map of 2**size bits of a long column. Tasks fill maps of their own, so that `tasks` * 2**size bits reach the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << size, bool)
        for batch in batches:
            own[_cells(batch.column(0).drop_null().to_numpy(), size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << (size - 3), np.uint8)
    for row in df.select(F.col(column).cast("long").alias("v")).coalesce(tasks).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out
