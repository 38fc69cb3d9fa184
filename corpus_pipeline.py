"""A corpus for training out of documents: language, near copies, personal data, mixture, tokens.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomkv.llm import bpe, language, mixture, near_copies, private
from loomkv.llm.shared import checkpoint_dir


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: those without letters and those that fit no language; lang becomes the language found."""
    return language.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the smallest doc_id."""
    return near_copies.unique(docs)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with marks in the place of personal data and secrets."""
    return private.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, at most mixture.MAX_EPOCHS times: a document comes as often as its source is drawn."""
    return mixture.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, same) of every row."""
    return bpe.encoded(docs)


STAGES = [("language", by_language), ("near copies", without_near_copies), ("private data", without_private_data), ("mixture", mixed_sources), ("tokens", as_tokens)]

#: SQL can express neither the language models nor the rest: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. What a stage returns is written to the shared folder and read again, so that no lineage is left; the last is not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    here, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(at := f"{here}/{k}")
        docs = spark.read.parquet(at)
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
