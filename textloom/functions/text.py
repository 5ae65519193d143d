"""Overlapping counts and positions of a literal pattern, in code points, as Columns.

The empty pattern occurs before each code point and at the end. A null text gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that an Arrow batch should hold at most (a single longer row still travels whole).
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4096


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session are bounded in bytes, so that a worker's memory doesn't grow with texts and tables, where Spark has the setting."""
    for key, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        try:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
        except Exception:  # noqa: BLE001  an older Spark: the row bound alone holds
            pass


def quoted(pattern: str) -> str:
    """A Java regular expression for exactly this text."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def has_border(pattern: str) -> bool:
    """Whether occurrences of a pattern can overlap: some proper prefix is also a suffix."""
    reach = [0] * len(pattern)
    for i in range(1, len(pattern)):
        k = reach[i - 1]
        while k and pattern[i] != pattern[k]:
            k = reach[k - 1]
        reach[i] = k + (pattern[i] == pattern[k])
    return bool(reach and reach[-1])


def overlap_count(text: Column | str, pattern: str) -> Column:
    """Occurrences of pattern, overlapping ones too (bigint).

    Occurrences of a pattern without a border can't overlap, so the bytes that replacing them removes
    count them, inside generated code; others go through a zero-width look-ahead.
    """
    text = F.col(text) if isinstance(text, str) else text
    if pattern == "":
        return (F.length(text) + 1).cast("bigint")
    if has_border(pattern):
        return F.regexp_count(text, F.lit(f"(?={quoted(pattern)})")).cast("bigint")
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(pattern), F.lit("")))
    return (gone / len(pattern.encode())).cast("bigint")


def each_found(text: str, pattern: str) -> Iterator[int]:
    """Ascending 0-based code-point offsets of all occurrences in one string, one by one."""
    if pattern == "":
        yield from range(len(text) + 1)
        return
    at = text.find(pattern)
    while at >= 0:
        yield at
        at = text.find(pattern, at + 1)


def find_all(text: str, pattern: str) -> list[int]:
    """The same offsets as a list."""
    return list(each_found(text, pattern))


def positions(text: Column | str, pattern: str) -> Column:
    """Offsets of all occurrences (array<bigint>, ascending), in Arrow batches: no built-in gives them in linear time."""
    text = F.col(text) if isinstance(text, str) else text
    if (session := SparkSession.getActiveSession()) is not None:
        bounded_batches(session)

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else find_all(t, pattern))

    return run(text)


def code_points(text: Column | str) -> Column:
    """The code points of a text (array<int>)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), F.ascii)).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))
