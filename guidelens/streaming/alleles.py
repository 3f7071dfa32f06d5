"""Allele counts over arriving FASTQ files: counts are the state, thresholds are applied when a result is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..operators.alleles import called, kept_and_ranked, target_hits
from ..operators.assign import assigned
from ..sources import fastq, splits
from .versions import Versions

SCOPE = ("gene_ix", "target_ix")
KEYS = (*SCOPE, "window", "read_window", "left_x", "right_x")


def observations(reads: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Counts by observation; no event time, so no watermark: each read counts once, whenever it comes."""
    hits = target_hits(assigned(reads, config).where("outcome = 'assigned'")).where("reason = 'ok'")
    return hits.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("read_index").alias("first"))


def added(state: DataFrame | None, more: DataFrame) -> DataFrame:
    """Counts of both; first is the smaller."""
    both = more if state is None else state.unionByName(more)
    return both.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def started(spark: SparkSession, folder: str, config: AnalysisConfig, table: str, checkpoint: str, files_a_batch: int = 1000, names: str = fastq.NAMES):
    """Count the FASTQ files of a folder until none is left, files_a_batch at a time.

    Each batch reads its files in as many tasks as they have blocks, and puts a version
    of the counts in place, once however often it is run: readers of the table (see
    Versions) never see part of a batch. Only names and sizes of files pass through the stream.
    """
    versions = Versions(spark, table, checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        def merged(state: DataFrame | None) -> DataFrame:
            paths = sorted(r.path for r in batch.collect())  # files_a_batch at most
            return added(state, observations(splits.read(spark, paths), config))

        if not batch.isEmpty():
            versions.commit(number, merged)

    files = fastq.arrivals(spark, folder, files_a_batch, names).select("path")
    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result(counts: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Ranked alleles over everything counted so far: one threshold for all, not one a batch."""
    groups = called(counts, config)
    first = F.struct("category", "has_sub", "net_indel")
    out = groups.groupBy(*SCOPE, F.col("allele").alias("read_inner")).agg(F.sum("n").alias("read_count"), F.min("first").alias("first_seen"), F.min_by(first, "first").alias("f")).select(*SCOPE, "read_inner", "read_count", "first_seen", "f.*")
    return kept_and_ranked(out, SCOPE, config.indel_percent)
