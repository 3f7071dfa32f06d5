"""Reads that fail or differ: what each kind becomes, from single calls to summaries and statistics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import pairs, summary
from ..operators.alleles import alleles, called, target_hits
from ..operators.assign import assigned
from ..plans.analysis import run_analysis
from .fixtures import HARD, TWO_GENES, TWO_TARGETS, hard_reads
from .registry import query

#: What becomes of a kind: assigned, ambiguous or filtered; and why its own gene and the other one have no observation.
_OUTCOME = "CASE WHEN kind = 11 THEN 'ambiguous' WHEN kind IN (4, 5, 6, 7, 9) THEN 'filtered' ELSE 'assigned' END"
_OWN = "CASE kind WHEN 4 THEN 'no_coverage' WHEN 5 THEN 'no_alignment' WHEN 6 THEN 'no_anchor' WHEN 7 THEN 'quality' WHEN 9 THEN 'quality' ELSE 'ok' END"
_OTHER = "CASE kind WHEN 6 THEN 'no_coverage' ELSE own END"
_FATE = HARD + f", own AS (SELECT *, {_OUTCOME} AS outcome, {_OWN} AS own FROM hard), fate AS (SELECT *, {_OTHER} AS other FROM own)"


def gene(c: str = "gene_ix"):
    return F.when(F.col(c) == 0, "A").when(F.col(c) == 1, "B")


def hard_calls(spark, sf_dir):
    return assigned(hard_reads(spark, sf_dir), TWO_GENES)


@query(f"{_FATE} SELECT read_index, outcome, CASE WHEN outcome = 'assigned' THEN true_gene END AS gene FROM fate")
def hard_assignment(spark, sf_dir):
    return hard_calls(spark, sf_dir).select("read_index", "outcome", gene().alias("gene"))


@query(
    f"""{_FATE} SELECT read_index, true_gene AS gene, own AS reason, own = 'ok' AND is_rc AS reverse, CAST(CASE WHEN own = 'ok' THEN CASE WHEN kind = 2 THEN 10 ELSE 0 END END AS INT) AS left_x, CAST(CASE WHEN own = 'ok' THEN CASE WHEN kind = 3 THEN 10 ELSE 0 END END AS INT) AS right_x FROM fate
    UNION ALL SELECT read_index, CASE true_gene WHEN 'A' THEN 'B' ELSE 'A' END, other, other = 'ok' AND is_rc, CAST(CASE WHEN other = 'ok' THEN 0 END AS INT), CAST(CASE WHEN other = 'ok' THEN 0 END AS INT) FROM fate WHERE outcome <> 'assigned'"""
)
def hard_windows(spark, sf_dir):
    """Each read's windows with why they can't be used, or what they leave unobserved: of its gene, or of both where it has none."""
    h = target_hits(hard_calls(spark, sf_dir))
    ok = F.col("reason") == "ok"
    return h.select("read_index", gene().alias("gene"), "reason", (ok & F.coalesce("is_rc", F.lit(False))).alias("reverse"), F.when(ok, F.col("left_x")).alias("left_x"), F.when(ok, F.col("right_x")).alias("right_x"))


_CALLED = _FATE + """, calls AS (SELECT *, CASE WHEN kind IN (2, 3) THEN ref ELSE fwd END AS allele, CASE WHEN kind = 10 THEN 'in_frame' ELSE 'no_indel' END AS category, kind IN (1, 10) AS has_sub, CAST(CASE WHEN kind = 10 THEN -3 ELSE 0 END AS INT) AS net_indel FROM fate WHERE outcome = 'assigned')"""


@query(f"{_CALLED} SELECT read_index, true_gene AS gene, allele, category, has_sub, net_indel FROM calls")
def hard_mutations(spark, sf_dir):
    """Substitutions, deletions and both; ends that aren't observed are filled from the reference."""
    hits = target_hits(hard_calls(spark, sf_dir).where("outcome = 'assigned'")).where("reason = 'ok'")
    return called(hits, TWO_GENES).select("read_index", gene().alias("gene"), "allele", "category", "has_sub", "net_indel")


_PARTS = "CASE kind WHEN 1 THEN 'equal:41,substitute:1,equal:58' WHEN 2 THEN 'unobserved:10,equal:90' WHEN 3 THEN 'equal:90,unobserved:10' WHEN 10 THEN 'equal:41,substitute:1,equal:22,delete:3,equal:33' ELSE 'equal:100' END"


@query(f"{_CALLED} SELECT read_index, {_PARTS} AS tokens FROM calls")
def hard_tokens(spark, sf_dir):
    """Runs of an alignment: kinds and lengths."""
    hits = target_hits(hard_calls(spark, sf_dir).where("outcome = 'assigned'")).where("reason = 'ok'")
    runs = F.array_join(F.transform("tokens", lambda t: F.concat(t["type"], F.lit(":"), F.length(t["val"]).cast("string"))), ",")
    return called(hits, TWO_GENES).select("read_index", runs.alias("tokens"))


@query(f"{_CALLED} SELECT file, true_gene AS gene, allele AS read_inner, count(*) AS read_count, min(read_index) AS first_seen, any_value(category) AS category, arg_min(has_sub, read_index) AS has_sub, any_value(net_indel) AS net_indel FROM calls GROUP BY file, true_gene, allele")
def hard_alleles(spark, sf_dir):
    hits = target_hits(hard_calls(spark, sf_dir).where("outcome = 'assigned'"))
    return alleles(hits, TWO_GENES).select("file", gene().alias("gene"), "read_inner", "read_count", "first_seen", "category", "has_sub", "net_indel")


@query(f"{_FATE} SELECT file, count(*) AS total, count(*) FILTER (outcome = 'assigned') AS assigned, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'filtered') AS filtered, count(*) FILTER (outcome <> 'filtered') AS usable FROM fate GROUP BY file")
def hard_demux(spark, sf_dir):
    return summary.demux_counts(hard_calls(spark, sf_dir)).drop("avg_best_score")


@query(f"{_FATE}, w AS (SELECT file, own AS reason FROM fate WHERE own <> 'ok' UNION ALL SELECT file, other FROM fate WHERE own <> 'ok') SELECT file, reason, count(*) AS n FROM w GROUP BY file, reason")
def hard_failures(spark, sf_dir):
    """All four reasons, over both genes' windows."""
    counts = summary.failure_counts(target_hits(hard_calls(spark, sf_dir)))
    return counts.groupBy("file", "reason").agg(F.sum("n").alias("n"))


@query(
    f"""{_FATE}, t AS (SELECT *, CASE WHEN kind = 4 AND true_gene = 'A' THEN 'assigned' ELSE outcome END AS now FROM fate),
    c AS (SELECT file, true_gene AS gene, unnest(CASE true_gene WHEN 'A' THEN ['t1', 't2'] ELSE ['t1'] END) AS target_id, kind, is_rc FROM t WHERE now = 'assigned'),
    u AS (SELECT *, NOT (kind = 4 AND target_id = 't1') AS ok FROM c)
    SELECT file, gene, target_id, count(*) AS total_reads, CAST(count(*) FILTER (ok) AS BIGINT) AS matched_reads, CAST(count(*) FILTER (ok AND NOT is_rc) AS BIGINT) AS forward_reads, CAST(count(*) FILTER (ok AND is_rc) AS BIGINT) AS reverse_reads,
      0::BIGINT AS fail_quality, 0::BIGINT AS fail_no_anchor, count(*) FILTER (NOT ok) AS fail_no_coverage, 0::BIGINT AS fail_no_alignment,
      0::BIGINT AS out_of_frame, count(*) FILTER (kind = 10) AS in_frame, count(*) FILTER (kind = 1) AS substitution, count(*) FILTER (ok AND kind NOT IN (1, 10)) AS unmodified FROM u GROUP BY file, gene, target_id"""
)
def hard_target_summary(spark, sf_dir):
    """Two targets of one gene, of which a short read covers one only: reasons by target, and substitutions apart from unmodified reads."""
    out = run_analysis(hard_reads(spark, sf_dir), replace(TWO_TARGETS, indel_percent=0.0)).summary
    target = F.when(F.col("target_ix") == 1, "t2").otherwise("t1").alias("target_id")
    numbers = ("total_reads", "matched_reads", "forward_reads", "reverse_reads", "fail_quality", "fail_no_anchor", "fail_no_coverage", "fail_no_alignment", "out_of_frame", "in_frame", "substitution", "unmodified")
    return out.where("total_reads > 0").select("file", gene().alias("gene"), target, *(F.col(c).cast("bigint").alias(c) for c in numbers))


#: Mates of hard reads: the first and last 60 bases, which overlap; those of kinds 2 and 3 don't meet, and 8 has a bad second mate.
_MATES = HARD + """, mates AS (SELECT read_index, kind, true_gene, fwd, ref, substring(fwd, 1, CASE WHEN kind IN (2, 3) THEN 80 ELSE 60 END) AS s1, right(fwd, CASE WHEN kind IN (2, 3) THEN 8 ELSE 60 END) AS e2 FROM hard WHERE kind IN (0, 1, 2, 3, 7, 8, 10))"""


def hard_mates(spark, sf_dir):
    apart = F.col("kind").isin(2, 3)
    n, m = F.when(apart, 80).otherwise(60), F.when(apart, 8).otherwise(60)
    r = hard_reads(spark, sf_dir).where(F.col("kind").isin(0, 1, 2, 3, 7, 8, 10))
    low = F.when(F.col("kind") == 7, "+").otherwise("D")
    second = F.reverse(F.translate(F.substring("fwd", F.length("fwd") - m + 1, m), "ACGT", "TGCA"))
    return r.select("read_index", "kind", F.substring("fwd", F.lit(1), n).alias("r1_seq"), F.repeat(low, n).alias("r1_qual"), second.alias("r2_seq"), F.repeat(F.when(F.col("kind") == 8, "+").otherwise(low), m).alias("r2_qual"))


@query(f"{_MATES} SELECT read_index, kind NOT IN (2, 3) AS merged, CASE WHEN kind IN (2, 3) THEN concat(s1, repeat('X', 90), e2) ELSE fwd END AS seq, CAST(CASE WHEN kind IN (2, 3) THEN 0 ELSE 120 - length(fwd) END AS INT) AS overlap FROM mates")
def hard_pairs(spark, sf_dir):
    """Mates that meet, and mates that don't, with X between."""
    return pairs.merged(hard_mates(spark, sf_dir), TWO_GENES).select("read_index", "merged", "seq", "overlap")


@query(f"{_MATES} SELECT count(*) AS input_molecules, count(*) FILTER (kind <> 7) AS phred_passed, count(*) FILTER (kind <> 7) AS normalized, count(*) FILTER (kind NOT IN (2, 3, 7)) AS consensus, count(*) FILTER (kind IN (2, 3)) AS padded, count(*) FILTER (kind = 7) AS filtered, count(*) FILTER (kind = 7) AS fail_quality FROM mates")
def hard_preprocess(spark, sf_dir):
    """Good, padded and bad molecules."""
    stats = pairs.preprocess_stats(pairs.judged(pairs.merged(hard_mates(spark, sf_dir), TWO_GENES), TWO_GENES), TWO_GENES)
    return stats.select("input_molecules", "phred_passed", "normalized", "consensus", "padded", "filtered", "fail_quality")
