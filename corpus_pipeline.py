"""The corpus pipeline: stages over documents, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guidelens.llm import bpe, mixing, neardup, secrets, toxicity
from guidelens.llm.common import table, written
from guidelens.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels of its input."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest id."""
    return neardup.deduplicated(docs, k=5, per_cent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target weight gives, 0 to 2 times."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document (copies included): its token ids' count and digest, and the decoded text's digest."""
    return bpe.digests(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("secret scan", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None  # learned models, similarity joins and BPE aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
