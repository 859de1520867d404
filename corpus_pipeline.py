"""Corpus pipeline: language ID, exact deduplication, near deduplication, removal of repeated
passages, packing. Each stage takes (spark, docs, sf_dir) and works on all rows of the stage
before, which are written as Parquet and read again in between; all but the last return the
columns of ``documents``.

Odd rows have the results that the operators' docstrings state: null texts and texts without a
letter go with language ID, copies and repeated rows with the deduplication, and an empty table
goes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragtab.llm import exact_dedup, langid, ngram_join, packing, suffix_dedup
from ragtab.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``und`` and uncertain ones go."""
    return langid.langid_stage(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by similarity."""
    return ngram_join.near_dedup_stage(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start earlier."""
    return suffix_dedup.suffix_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full context windows."""
    return packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("pack", pack)]

#: Language prediction and token ids can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
