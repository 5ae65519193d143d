"""The registered query of each operator, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata_dedup, bytebpe, knn_join, near_dedup, neighbour_graph, packing, quality, secrets, suffix_dedup, token_records
from .common import saved, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as binary records and read back from them."""
    index = token_records.token_records(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "n_bytes")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, packed by vector best fit.

    As sequences are to be as few as 4096 tokens allow, documents and attention cost have the capacity that as many
    tokens can need; their residuals choose among the bins with room all the same.
    """
    found = saved(packing.pieces(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")), "pieces")
    return packing.pack(found, packing.Capacity(tokens=4096, documents=4096, attention=4096**2, weights=(1.0, 0.25, 0.25)))


def op3_voronoi_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    rows = knn_join.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return knn_join.top_k(rows, rows.where(F.col("id") % 20 == 0), 20)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without 100-byte strings that start earlier."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of base patterns and linked credentials in every document."""
    got = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "linked")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), n("linked"))


def op6_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by co-trained views of its text and its page."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest that graph search finds for every 100th vector."""
    rows = knn_join.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None, nonzero=True)
    return neighbour_graph.search(neighbour_graph.build(rows), rows.where(F.col("id") % 100 == 0), 10)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without 50-word windows of earlier documents."""
    return automata_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and their decoding."""
    import public_tokenizers

    return bytebpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles are linked at a similarity of 0.85 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e::DOUBLE[], d.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_voronoi_knn_join": OP3_SQL}
