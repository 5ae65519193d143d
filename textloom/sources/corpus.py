"""A corpus: documents with unique ids, checked once, then plain DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_points
from .store import read_note, write_note

SCHEMA = "doc_id bigint, text string"


@dataclass(frozen=True)
class Stats:
    num_docs: int
    total_num_chars: int
    #: Bits of the largest code point plus one; 0 without characters.
    max_bit: int


class Corpus:
    """documents has doc_id bigint and text string, neither null, ids unique; further columns are carried."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents
        self.spark: SparkSession = documents.sparkSession

    @classmethod
    def from_text(cls, spark: SparkSession, text: str) -> "Corpus":
        """One document, with id 0."""
        if not isinstance(text, str):
            raise TypeError("The text must be a string.")
        return cls(spark.createDataFrame([(0, text)], SCHEMA))

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: Iterable[str]) -> "Corpus":
        """A document for each string; ids are places in the iterable. TypeError for anything else."""
        rows = list(enumerate(texts))
        if not all(isinstance(t, str) for _, t in rows):
            raise TypeError("All elements in the sequence must be strings.")
        return cls(spark.createDataFrame(rows, SCHEMA))

    @classmethod
    def from_table(cls, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> "Corpus":
        """Rows of any table that Spark reads. ValueError for null or repeated ids and null texts, in one checking job."""
        out = table
        if id_col != "doc_id":
            out = out.withColumnRenamed(id_col, "doc_id")
        if text_col != "text":
            out = out.withColumnRenamed(text_col, "text")
        if dict(out.dtypes)["doc_id"] != "bigint":
            out = out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
        if check:
            of_id = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"))
            bad = of_id.agg(F.count_if(F.col("doc_id").isNull()).alias("no_id"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("no_text")).first()
            for n, what in ((bad.no_id, "null doc_id"), (bad.repeated, "doc_id values that repeat"), (bad.no_text, "null text")):
                if n:
                    raise ValueError(f"the corpus has {what} ({n})")
        return cls(out)

    @cached_property
    def num_docs(self) -> int:
        return self.documents.count()

    @cached_property
    def stats(self) -> Stats:
        """One pass over the corpus."""
        top = F.coalesce(F.array_max(code_points("text")) + 1, F.lit(0))
        row = self.documents.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.max(top), F.lit(0)).alias("top")).first()
        return Stats(row.n, row.chars, int(row.top).bit_length())

    def items(self) -> DataFrame:
        """(doc_id, text), ordered."""
        return self.documents.select("doc_id", "text").orderBy("doc_id")

    def cached(self) -> "Corpus":
        return Corpus(self.documents.persist())

    def save(self, path: str) -> "Corpus":
        """Write the corpus as Parquet under path (it must not exist), and return the corpus read from there."""
        self.documents.write.parquet(f"{path}/documents")
        write_note(self.spark, f"{path}/note", {"kind": "corpus", "version": 1})
        return Corpus.load(self.spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Corpus":
        if read_note(spark, f"{path}/note").get("kind") != "corpus":
            raise ValueError(f"{path} holds no corpus")
        return cls(spark.read.parquet(f"{path}/documents"))
