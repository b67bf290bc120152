"""Corpus pipeline: language, near copies, mixing, tokens.

``STAGES`` run in order; each gets what the one before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import bpe, language, mixing, ngram_join
from emberlake.session import checkpoint_root

#: No source is passed over more often than this; every source at least once.
MAX_EPOCHS = 2.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach."""
    return language.accepted(docs, language.learn(docs, F.lit(True)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight says; those of small sources may come twice."""
    return mixing.mixed(docs, max_epochs=MAX_EPOCHS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language", known_language), ("near-copies", one_of_each_group), ("mixing", mixed_sources), ("tokens", encoded)]
#: No SQL can express a trained classifier or the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
