"""From raw documents to token ids: quality, near-duplicates, repeated passages, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivescope.llm.bpe import bpe_encode
from drivescope.llm.frames import table
from drivescope.llm.minmax import first_of_each
from drivescope.llm.mixing import mixed_documents
from drivescope.llm.quality import accepted_documents
from drivescope.llm.repeats import documents_without_repeats
from drivescope.operators.staging import materialize

NEAR_WORDS, NEAR_PERCENT, REPEAT_WORDS = 5, 80, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learnt from ``labels`` doesn't reject."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return first_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that occur more than once."""
    return documents_without_repeats(docs, REPEAT_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of every document."""
    kept = docs.select("doc_id", "text", "source")
    ids = bpe_encode(kept.select(F.struct("doc_id", "source").alias("doc_id"), "text"), public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("id.doc_id", "id.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("token_ids", token_ids)]

#: The ranking and the draws of the mixture aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
