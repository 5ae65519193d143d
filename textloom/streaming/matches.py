"""Stateless matches on a stream, and counts in event-time windows.

A stream has text string and whatever else; ``operators.search`` works on it as well, except for
what sorts or groups whole results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_count, positions


def matches(stream: DataFrame, pattern: str, with_positions: bool = False) -> DataFrame:
    """Rows whose text holds pattern, with n and, if asked for, positions. No state, so any output mode but complete."""
    held = stream.where(F.col("text").contains(pattern)).withColumn("n", overlap_count("text", pattern))
    return held.withColumn("positions", positions("text", pattern)) if with_positions else held


def counts_by_window(stream: DataFrame, pattern: str, time_col: str, window: str, late: str) -> DataFrame:
    """(start, end, n_docs, n) of event-time windows; rows later than ``late`` behind the newest drop out, so state is bounded."""
    held = matches(stream, pattern).withWatermark(time_col, late)
    by = held.groupBy(F.window(time_col, window).alias("w")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))
    return by.select("w.start", "w.end", "n_docs", "n")
