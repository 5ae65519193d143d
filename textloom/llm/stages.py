"""Operators as filters and rewriters of a table of documents, for pipelines.

Each takes and returns the columns of documents; rows that share a doc_id, and null doc_ids, count as
documents of their own. Where a text changes, n_chars follows, if there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup, quality, secrets, suffix_dedup
from .common import arrow_bounds, keyed_rows, only, saved

REDACTED = "[SECRET]"


def _as_before(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from (row, text)."""

    def column(name: str):
        if name.lower() == "text":
            return F.col("text").alias(name)
        if name == "n_chars":
            return F.length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col("row").getField(name).alias(name)

    return changed.select(*map(column, docs.columns))


def good_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the co-trained classifier, trained on docs and labels, keeps; an empty table gives an empty result, and without both classes of labels all stay."""
    found = quality.scored(docs, quality.train(docs, labels))
    kept = found.where(F.col("quality") >= quality.THRESHOLD)
    return kept.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates; those without words all stay, and an empty table gives an empty result."""
    rows = keyed_rows(docs)
    keyed = rows.select("key", F.col("row").getField("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    arrow_bounds(docs.sparkSession)
    gone = saved(near_dedup.near_components(keyed, size, percent).where("key <> component").select("key"), "gone")
    kept = only(rows, gone, "left_anti")
    return kept.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def without_repeats(docs: DataFrame, window: int = suffix_dedup.WINDOW) -> DataFrame:
    """All documents, their texts without strings that start earlier; a text may end up empty, and a null one is empty."""
    rows = keyed_rows(docs)
    kept = suffix_dedup.dedup(rows.select(F.col("key").alias("doc_id"), "text"), window, texts=True)
    return _as_before(rows.select("key", "row").join(kept.select(F.col("doc_id").alias("key"), F.col("kept_text").alias("text")), "key"), docs)


def without_secrets(docs: DataFrame, mask: str = REDACTED) -> DataFrame:
    """All documents, each secret's span replaced by a mask, overlapping ones by one; a null text stays null."""
    rows = keyed_rows(docs)
    found = secrets.scan(rows.select(F.col("key").alias("doc_id"), "text")).where(F.size("spans") > 0)
    kind = "array<struct<start:bigint,end:bigint>>"
    span = lambda s, e: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"))
    last = lambda done: F.element_at(done, -1)

    def merged(done, x):
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(span(last(done)["start"], F.greatest(last(done)["end"], x["end"]))))
        return F.when((F.size(done) > 0) & (x["start"] < F.element_at(F.concat(F.array(span(F.lit(0), F.lit(0))), done), -1)["end"]), wider).otherwise(F.concat(done, F.array(x)))

    spans = F.array_sort(F.transform("spans", lambda x: span(x["start"], x["end"])))
    cuts = found.select(F.col("doc_id").alias("key"), F.aggregate(spans, F.array().cast(kind), merged).alias("cuts"))
    joined = rows.join(cuts, "key", "left")
    # what stands before each cut, with the mask, and then the rest
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda x: x["end"]))
    before = F.transform("cuts", lambda x, i: F.concat(F.substr("text", (F.get(ends, i) + 1).cast("int"), (x["start"] - F.get(ends, i)).cast("int")), F.lit(mask)))
    made = F.concat(F.array_join(before, ""), F.substr("text", (F.element_at(ends, -1) + 1).cast("int")))
    return _as_before(joined.select("row", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(made).alias("text")), docs)
