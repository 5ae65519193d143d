"""From raw documents to packed token sequences: quality, near-dedup, substring dedup, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import packing, stages
from textloom.llm.common import saved, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier doesn't reject."""
    return stages.good_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return stages.one_of_each_group(docs, 5, 80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier in the corpus."""
    return stages.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with credentials masked."""
    return stages.without_secrets(docs)


#: A training sequence: attention costs what one document of all its tokens would at most, and short documents don't crowd it.
SEQUENCE = packing.Capacity(tokens=4096, documents=256, attention=4096**2, weights=(1.0, 0.25, 0.25))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids and their places in sequences, which keep every limit of SEQUENCE."""
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE.tokens)
    return packing.pack(saved(found, "pieces"), SEQUENCE)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]
#: SQL can express neither the classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
