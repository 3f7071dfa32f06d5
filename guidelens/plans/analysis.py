"""Whole runs: reads (or pairs) to assignments, alleles and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..operators import pairs as mates
from ..operators.alleles import SCOPE, alleles_of, kept_and_ranked, observed, target_hits
from ..operators.assign import assigned
from ..operators.summary import among, demux_counts, every_target, gene_counts, missing_guides, rescued, target_summary
from ..sources.shared import written


@dataclass(frozen=True)
class Result:
    """calls and hits are one row a read, and a read and target; the rest are small."""

    calls: DataFrame
    hits: DataFrame
    alleles: DataFrame
    summary: DataFrame
    demux: DataFrame
    genes: DataFrame


def hits_by_kind(calls: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Hits of assigned reads (normal), and of ambiguous ones against the gene that rescues them, or all genes."""
    out = target_hits(calls.where("outcome = 'assigned'"))
    if not config.analyze_ambiguous:
        return out
    unsure = calls.where("outcome = 'ambiguous'")
    if not config.rescue:
        return out.unionByName(target_hits(unsure, "ambiguous"))
    saved = rescued(calls, config).where("rescued").select("file", "read_index", "best_gene_ix")
    marked = unsure.join(saved, ["file", "read_index"], "left")
    back = target_hits(marked.where("best_gene_ix is not null"), "rescued").where("gene_ix = best_gene_ix").drop("best_gene_ix")
    rest = target_hits(marked.where("best_gene_ix is null"), "ambiguous").drop("best_gene_ix")
    return out.unionByName(back).unionByName(rest)


def run_analysis(reads: DataFrame, config: AnalysisConfig, config_key: str | None = None) -> Result:
    """reads: file, read_index, seq, qual.

    One pass over the reads leaves what they observe, counted, as a table in the shared
    folder, from which alleles and summary come; counts by gene and of demultiplexing
    come from Result.calls, which a caller who wants them all may persist.

    The summary has a row for every configured target of each file; a target whose
    guide isn't in its reference has an error there, and no alleles. Runs with
    reference sets by input (config_key) have the rows that reads give.
    """
    calls = assigned(reads, config, config_key)
    hits = hits_by_kind(calls, config)
    gone = missing_guides(config) if config_key is None else []
    seen = written(observed(hits, config_key), "observations")
    every = alleles_of(seen.where(~among(gone)) if gone else seen, config, config_key)
    good = kept_and_ranked(every, SCOPE, config.indel_percent)
    summary = target_summary(seen, good)
    if config_key is None:
        summary = every_target(summary, reads.select("file").distinct(), config)
    return Result(calls, hits, good, summary, demux_counts(calls), gene_counts(calls, config))


def paired_reads(r1: DataFrame, r2: DataFrame, config: AnalysisConfig) -> tuple[DataFrame, DataFrame]:
    """(reads for run_analysis, all molecules with what became of them) of two mate tables with pair_id, read_index, read_id, seq, qual."""
    molecules = mates.judged(mates.merged(mates.mate_records(r1, r2), config), config)
    reads = molecules.where("passes").select(F.col("pair_id").alias("file"), "read_index", F.coalesce("r1_id", "r2_id").alias("read_id"), "seq", "qual")
    return reads, molecules
