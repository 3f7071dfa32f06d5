"""Accuracy on labelled reads, statistics of read files, and the viewer's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.sequence import gc_of_read, iupac_regex, phred_sum
from .alleles import percent


def confusion(calls: DataFrame, truth: str = "true_gene") -> DataFrame:
    """gene (All for the total), reads, usable, correct, wrong, ambiguous, and rates at one decimal; calls have predicted, outcome, truth."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    done, right = F.col("outcome") == "assigned", F.col("predicted") == F.col(truth)
    out = calls.groupingSets([[truth], []], truth).agg(F.grouping(truth).alias("_all"), F.count(F.lit(1)).alias("total"), n(F.col("outcome") != "filtered", "usable"), n(F.col("outcome") == "filtered", "filtered"), n(done & right, "correct"), n(done & ~right, "wrong"), n(F.col("outcome") == "ambiguous", "ambiguous"))
    rates = {f"{c}_rate": percent(F.col(c), F.col("usable"), 1) for c in ("correct", "wrong", "ambiguous")}
    return out.withColumns(rates).select(F.when(F.col("_all") == 1, "All").otherwise(F.col(truth)).alias("gene"), "total", "usable", "filtered", "correct", "wrong", "ambiguous", *rates)


#: Why a labelled read may not be usable at its own target.
FAILURES = ("no_anchor", "quality", "similarity", "no_coverage", "no_alignment")


def accuracy(calls: DataFrame, config: AnalysisConfig, gene: str = "true_gene", target: str = "true_target") -> DataFrame:
    """Calls (outcome, gene_ix, hits, and the true gene and target) by true gene and target, and over all (gene and target "All").

    A call is correct when its gene is. Rates of usable reads and of all reads are in
    per cent at one decimal; fail_* count the reads that no gene can use by the reason
    at their own target. Configured targets without reads have zeros.
    """
    names = F.array(*(F.lit(g.gene) for g in config.genes))
    ids = F.array(*(F.array(*(F.lit(t.target_id) for t in g.targets)).cast("array<string>") for g in config.genes))
    name = lambda g: F.get(names, g)
    own = F.filter("hits", lambda h: (name(h["gene_ix"]) == F.col(gene)) & (F.get(F.get(ids, h["gene_ix"]), h["target_ix"]) == F.col(target)))
    hit = name(F.col("gene_ix")) == F.col(gene)
    verdict = F.when(F.col("outcome") != "assigned", F.col("outcome")).when(hit, "correct").otherwise("wrong")
    judged = calls.select(F.col(gene).alias("gene"), F.col(target).alias("target"), verdict.alias("verdict"), F.when(F.col("outcome") == "filtered", F.get(own, F.lit(0))["reason"]).alias("why"), F.lit(1).alias("n"))
    known = [F.struct(F.lit(g.gene).alias("gene"), F.lit(t.target_id).alias("target")) for g in config.genes for t in g.targets]
    if known:
        zeros = calls.sparkSession.range(1).select(F.inline(F.array(*known))).select("gene", "target", *(F.lit(None).cast("string").alias(c) for c in ("verdict", "why")), F.lit(0).alias("n"))
        judged = judged.unionByName(zeros)
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    kinds = ("correct", "wrong", "ambiguous", "filtered")
    out = judged.groupingSets([["gene", "target"], []], "gene", "target").agg(F.grouping("gene").alias("_all"), n(F.lit(True), "total"), *(n(F.col("verdict") == k, k) for k in kinds), *(n(F.col("why") == w, f"fail_{w}") for w in FAILURES))
    out = out.withColumn("usable", F.col("total") - F.col("filtered"))
    rates = {"usable_rate": percent(F.col("usable"), F.col("total"), 1)} | {f"{k}_rate": percent(F.col(k), F.col("usable"), 1) for k in kinds[:3]} | {f"{k}_rate_total": percent(F.col(k), F.col("total"), 1) for k in kinds[:3]}
    label = lambda c: F.when(F.col("_all") == 1, "All").otherwise(F.col(c)).alias(c)
    return out.withColumns(rates).select(label("gene"), label("target"), "total", "usable", *kinds, *rates, *(f"fail_{w}" for w in FAILURES))


def fastq_stats(reads: DataFrame) -> DataFrame:
    """reads, lengths, mean GC of reads, mean quality of bases; empty reads count as reads only."""
    size = F.length("seq")
    full = F.when(size > 0, size)
    return reads.agg(F.count(F.lit(1)).alias("reads"), (F.sum(full) / F.count(F.lit(1))).alias("avg_length"), F.min(full).alias("min_length"), F.max(full).alias("max_length"), (F.sum(F.when(size > 0, gc_of_read(F.col("seq")))) / F.count(F.lit(1))).alias("avg_gc"), (F.sum(phred_sum(F.col("qual"))) / F.sum(F.length("qual"))).alias("avg_quality"))


def length_histogram(reads: DataFrame, bucket: int = 10) -> DataFrame:
    return reads.where(F.length("seq") > 0).groupBy((F.floor(F.length("seq") / bucket) * bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quality_histogram(reads: DataFrame, bucket: int = 2) -> DataFrame:
    """Bases by quality; a read gives one row for each quality it has, with the number of its bases."""
    qual = F.col("qual")
    marks = F.array_distinct(F.filter(F.split(qual, ""), lambda c: c != ""))
    counted = F.transform(marks, lambda c: F.struct((F.ascii(c) - 33).alias("q"), (F.length(qual) - F.length(F.replace(qual, c))).alias("bases")))
    return reads.select(F.inline(counted)).groupBy((F.floor(F.col("q") / bucket) * bucket).cast("bigint").alias("bucket")).agg(F.sum("bases").alias("n"))


def viewer_filter(reads: DataFrame, query: str) -> DataFrame:
    """Reads whose id or category holds the query, or whose sequence holds it as an IUPAC motif."""
    low = query.lower()
    return reads.where(F.lower("read_id").contains(low) | F.lower("category").contains(low) | F.col("seq").rlike(f"(?i){iupac_regex(query, True)}"))


def viewer_page(reads: DataFrame, page: int, size: int = 10) -> DataFrame:
    """A page of reads, aligned ones first, each part in file order."""
    return reads.orderBy(F.desc("aligned"), "read_index").offset(page * size).limit(size)
