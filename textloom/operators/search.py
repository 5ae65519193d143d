"""Exact substring search over documents (doc_id bigint, text string): DataFrames in, DataFrames out.

Every scan starts with a predicate that reaches the Parquet reader and reads two columns. Only
``top_k`` and the grouped form of ``locate`` have anything to shuffle, and the former only k rows a
task. Occurrences overlap, offsets are 0-based code points, and rows come in no order unless said.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.text import bounded_batches, each_found, overlap_count, quoted

#: Rows of occurrences that a worker holds before it hands them on.
FOUND_ROWS = 1 << 16


def _holding(docs: DataFrame, pattern: str, doc_id: int | None = None) -> DataFrame:
    docs = docs if doc_id is None else docs.where(F.col("doc_id") == doc_id)
    return docs.where(F.col("text").contains(pattern)) if pattern else docs.where(F.col("text").isNotNull())


def containing(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id) of documents that hold pattern somewhere."""
    return _holding(docs, pattern).select("doc_id")


def equal_to(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id) of documents that are exactly this text."""
    return docs.where(F.col("text") == text).select("doc_id")


def starting_with(docs: DataFrame, prefix: str) -> DataFrame:
    """(doc_id) of documents that start with prefix; all of them for the empty one."""
    return docs.where(F.col("text").startswith(prefix)).select("doc_id")


def ending_with(docs: DataFrame, suffix: str) -> DataFrame:
    """(doc_id) of documents that end with suffix; all of them for the empty one."""
    return docs.where(F.col("text").endswith(suffix)).select("doc_id")


def counts(docs: DataFrame, pattern: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, n) of documents with one occurrence at least."""
    return _holding(docs, pattern, doc_id).select("doc_id", overlap_count("text", pattern).alias("n"))


def count_all(docs: DataFrame, pattern: str) -> DataFrame:
    """(n): occurrences in all documents, 0 if there are none."""
    return counts(docs, pattern).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def top_k(docs: DataFrame, pattern: str, k: int) -> DataFrame:
    """(doc_id, n) of the k documents with most occurrences; ties go to the smaller doc_id, fewer than k give all."""
    if k <= 0:
        raise ValueError("k must be greater than 0") if k == 0 else OverflowError("k can't be negative")
    return counts(docs, pattern).orderBy(F.col("n").desc(), "doc_id").limit(k)


def locate(docs: DataFrame, pattern: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, pos) of every occurrence, without a shuffle."""
    held = _holding(docs, pattern, doc_id)
    if pattern == "":
        return held.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.length("text").cast("bigint"))).alias("pos"))
    bounded_batches(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"], *StructType().add("pos", LongType()).fields])
    return held.select("doc_id", "text").mapInArrow(_located(pattern), schema)


def _located(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, text) a row (doc_id, pos) for each occurrence; a text at a time, and FOUND_ROWS of rows at most, so that memory doesn't grow with batches or hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column(1)):
                for pos in each_found(text.as_py(), pattern):
                    at.append(i)
                    hits.append(pos)
                    if len(hits) >= FOUND_ROWS:
                        yield handed(batch, at, hits)
                        at, hits = [], []
            if hits:
                yield handed(batch, at, hits)

    def handed(batch: pa.RecordBatch, at: list[int], hits: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.int64())], ["doc_id", "pos"])

    return run


def locate_by_windows(docs: DataFrame, pattern: str, doc_id: int | None = None) -> DataFrame:
    """``locate`` of built-in functions alone, where workers have no Python; a shuffle by document.

    A split in front of each occurrence leaves pieces whose running length gives the offsets.
    """
    if pattern == "":
        return locate(docs, pattern, doc_id)
    pieces = F.split("text", f"(?={quoted(pattern)})", -1)
    rows = _holding(docs, pattern, doc_id).select("doc_id", F.col("text").startswith(pattern).alias("_first"), F.posexplode(F.transform(pieces, F.length)).alias("_i", "_n"))
    before = Window.partitionBy("doc_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", (F.sum("_n").over(before) - F.col("_n")).cast("bigint"))
    return rows.where("_i > 0 or _first").select("doc_id", "pos")


def grouped(found: DataFrame) -> DataFrame:
    """(doc_id, positions array<bigint>) of located rows, ascending."""
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, at, text, owned): cuts of long texts that overlap, so that one huge document feeds many tasks.

    at is the code-point offset of a chunk; occurrences that start before ``owned`` are its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                starts = range(0, len(text) + 1, size)
                last = starts[-1]
                for a in range(0, len(starts), 64):
                    own = starts[a : a + 64]
                    rows = {"doc_id": [key] * len(own), "at": list(own), "text": [text[s : s + size + overlap] for s in own], "owned": [size + (s == last) for s in own]}
                    yield pa.RecordBatch.from_pydict(rows, schema=kind)

    bounded_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("text", pa.string()), ("owned", pa.int64())])
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, at bigint, text string, owned bigint")


def locate_in_chunks(docs: DataFrame, pattern: str, size: int = 1 << 20) -> DataFrame:
    """``locate`` for corpora of few huge documents: chunks are dealt evenly to all tasks first."""
    cut = chunks(docs, size, max(0, len(pattern) - 1)).repartition("doc_id", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                key, at, text, owned = (x.as_py() for x in row)
                found = (at + i for i in each_found(text, pattern) if i < owned)
                while hits := list(islice(found, FOUND_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "pos"])

    return cut.mapInArrow(run, "doc_id bigint, pos bigint")
