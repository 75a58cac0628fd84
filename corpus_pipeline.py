"""The corpus pipeline: every stage calls one operator of reviewmill.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewmill.llm import bpe, exact, mixing, ngrams, toxicity
from reviewmill.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a chain trained on the labelled ones calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train_chain(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word Jaccard 0.8, the one with the smallest id stays."""
    return ngrams.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text."""
    return bpe.encode_and_check(docs, VOCABULARY)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("ngram jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

#: Training and sampling have no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
