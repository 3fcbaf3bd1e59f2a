"""The corpus pipeline: from raw documents to packed training sequences.

Every stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next one's ``docs``. All but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadcast.llm import mixing, packing, pii, quality, shingles
from loadcast.llm.common import stage, table
from loadcast.llm.queries import WORD_VOCABULARY


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by SimHash, then 5-word Jaccard similarity of 0.8 or more."""
    return shingles.keep_one(docs, words_in_shingle=5, similarity=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it."""
    return mixing.taken_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in sequences; workers keep half as many looked-up chunks as in op 2."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY), chunks_kept=400_000,
                                  slice_bytes=2_000_000)


STAGES = [("quality", good), ("near_duplicates", without_near_copies), ("personal_data", without_personal_data),
          ("mix", mixed), ("pack", packed)]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
