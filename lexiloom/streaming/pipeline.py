"""Feature extraction and funnel counts on streams of messages.

Features are a projection, so they run on a stream as on a table. The funnel counts messages per source in event-time
windows behind a watermark; rows later than it are dropped by the engine, rows without a time belong to no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import style
from lexiloom.operators import screen


def stream_features(messages: DataFrame, names: list[str] | None = None, text_col: str = "text") -> DataFrame:
    return style.features(messages, text_col, names)


def stream_unique(messages: DataFrame, id_col: str, time_col: str, watermark: str = "60 days") -> DataFrame:
    """Each id once, the state bounded by the watermark."""
    return messages.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([id_col])


def stream_funnel(messages: DataFrame, time_col: str, window: str = "1 day", watermark: str = "60 days", label_col: str = "label") -> DataFrame:
    """start, source and the counts of the funnel."""
    judged = messages.withColumn("reason", screen.reason(F.col("text"), F.col(label_col) == 0)).where(F.col(time_col).isNotNull())
    counts = [F.count("*").alias("messages"), *[F.count_if(F.col("reason") == r).alias(r if r == "kept" else f"excluded_{r}") for r in screen.REASONS]]
    grouped = judged.withWatermark(time_col, watermark).groupBy(F.window(time_col, window).alias("w"), "source").agg(*counts)
    return grouped.select(F.col("w.start").alias("start"), "source", *[c for c in grouped.columns if c not in ("w", "source")])
