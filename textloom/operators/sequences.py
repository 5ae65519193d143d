"""Queries on an integer sequence, a table (pos bigint, value bigint) with pos 0..n-1: the algebra beneath an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import saved
from .numbering import lookup, numbered, running_sum


def length(seq: DataFrame) -> int:
    return seq.count()


def max_bit(seq: DataFrame) -> int:
    """Bits of the largest value, 0 without any."""
    return shape(seq).first().max_bit


def shape(seq: DataFrame) -> DataFrame:
    """(length, max_bit): places, and bits of the largest value, 0 without any; one row."""
    top = F.coalesce(F.max("value"), F.lit(0)).cast("bigint")
    bits = F.when(top == 0, 0).otherwise(F.length(F.bin(top))).cast("int")
    return seq.agg(F.count("*").alias("length"), bits.alias("max_bit"))


def _within(seq: DataFrame, end: int, inclusive: bool) -> None:
    if end < 0:
        raise OverflowError("places can't be negative")
    if end > 0 or not inclusive:
        n = length(seq)
        if end > n or (end == n and not inclusive):
            raise IndexError("index out of bounds")


def access(seq: DataFrame, at: int) -> DataFrame:
    """(value) at a place; IndexError beyond the end."""
    _within(seq, at, False)
    return seq.where(F.col("pos") == at).select("value")


def rank(seq: DataFrame, value: int, end: int) -> DataFrame:
    """(n): how often value stands before end; IndexError for an end beyond the length."""
    _within(seq, end, True)
    return seq.where((F.col("pos") < end) & (F.col("value") == value)).agg(F.count("*").alias("n"))


def run_starts(seq: DataFrame) -> DataFrame:
    """(value, n, less): count of each value, and of all smaller ones, which is where its run starts in sorted order."""
    return running_sum(seq.groupBy("value").agg(F.count("*").alias("n")), "value", "n", "less").select("value", "n", "less")


def ranks(seq: DataFrame) -> DataFrame:
    """(pos, value, rank): for every place, how often its value stands before. A value may hold most places."""
    starts = saved(run_starts(seq), "starts")
    placed = numbered(seq.select("pos", "value"), ["value", "pos"], "_place")
    return lookup(placed, starts, "value", "n").select("pos", "value", (F.col("_place") - F.col("less")).alias("rank"))


def select(seq: DataFrame, value: int, k: int) -> DataFrame:
    """(pos) of the k-th place (from 1) that holds value; no row if there are fewer."""
    if k <= 0:
        raise ValueError("k must be greater than 0")
    own = numbered(seq.where(F.col("value") == value).select("pos"), ["pos"], "_i")
    return own.where(F.col("_i") == k - 1).select("pos")


def _frequencies(seq: DataFrame, start: int, end: int) -> DataFrame:
    if start > end:
        raise ValueError("start must be less than or equal to end")
    _within(seq, end, True)
    return seq.where((F.col("pos") >= start) & (F.col("pos") < end)).groupBy("value").agg(F.count("*").alias("n"))


def range_frequencies(seq: DataFrame, start: int, end: int) -> DataFrame:
    """(value, n) of values at places start <= pos < end, by ascending value; no row for an empty range.

    ValueError for a start beyond the end, IndexError for an end beyond the length.
    """
    return _frequencies(seq, start, end).orderBy("value")


def top_k(seq: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """(value, n) of the k most frequent values of a range; ties go to the smaller value. Errors as for ``range_frequencies``."""
    found = _frequencies(seq, start, end)
    if k <= 0:
        raise ValueError("k must be greater than 0")
    return found.orderBy(F.col("n").desc(), "value").limit(k)


def values(seq: DataFrame) -> DataFrame:
    """(pos, value), ordered."""
    return seq.select("pos", "value").orderBy("pos")
