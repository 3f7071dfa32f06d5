"""Counts: demultiplexing, targets, multi-target edits, rescue of ambiguous reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..kernels.cutsite import windows_of
from .alleles import SCOPE, called, percent

#: Fixed value: the error of a target without its guide.
GUIDE_MISSING = "gRNA not found in reference"
FAILURE_COLUMNS = ("quality", "no_anchor", "no_coverage", "no_alignment")


def gene_table(reads: DataFrame, config: AnalysisConfig) -> DataFrame:
    """gene_ix, gene, display, homoeolog_group of the configuration."""
    rows = [F.struct(F.lit(i).alias("gene_ix"), F.lit(g.gene).alias("gene"), F.lit(g.display or g.gene).alias("display"), F.lit(g.homoeolog_group).cast("string").alias("homoeolog_group")) for i, g in enumerate(config.genes)]
    return reads.sparkSession.range(1).select(F.inline(F.array(*rows)))


def target_table(reads: DataFrame, config: AnalysisConfig) -> DataFrame:
    """gene_ix, target_ix, target_id of the configuration."""
    rows = [F.struct(F.lit(i).alias("gene_ix"), F.lit(j).alias("target_ix"), F.lit(t.target_id).alias("target_id")) for i, g in enumerate(config.genes) for j, t in enumerate(g.targets)]
    return reads.sparkSession.range(1).select(F.inline(F.array(*rows)))


def demux_counts(calls: DataFrame) -> DataFrame:
    """file: total, assigned, ambiguous, filtered, usable and the mean best score of usable reads."""
    n = lambda what: F.coalesce(F.sum(F.when(F.col("outcome") == what, 1)), F.lit(0)).alias(what)
    out = calls.groupBy("file").agg(F.count(F.lit(1)).alias("total"), n("assigned"), n("ambiguous"), n("filtered"), F.avg("top1").alias("avg_best_score"))
    return out.withColumn("usable", F.col("total") - F.col("filtered"))


def gene_counts(calls: DataFrame, config: AnalysisConfig) -> DataFrame:
    """file, gene, assigned reads; genes without reads stay, with 0."""
    counts = calls.groupBy("file", "gene_ix").agg(F.count(F.lit(1)).alias("n"))
    held = F.map_from_entries(F.filter(F.collect_list(F.struct("gene_ix", "n")), lambda g: g["gene_ix"].isNotNull()))  # reads of no gene only tell that the file is there
    genes = F.array(*(F.struct(F.lit(i).alias("gene_ix"), F.lit(g.gene).alias("gene")) for i, g in enumerate(config.genes)))
    every = counts.groupBy("file").agg(held.alias("held")).select("file", "held", F.inline(genes))
    return every.select("file", "gene", F.coalesce(F.element_at("held", F.col("gene_ix")), F.lit(0)).cast("long").alias("assigned"))


def failure_counts(hits: DataFrame) -> DataFrame:
    """Reads by scope and reason, usable ones left out: the long form of a failure map."""
    return hits.where("reason <> 'ok'").groupBy(*SCOPE, "reason").agg(F.count(F.lit(1)).alias("n"))


def target_summary(observations: DataFrame, kept_alleles: DataFrame) -> DataFrame:
    """Totals and breakdown of each scope: reads before the threshold from observed() hits, classes after it from the alleles kept."""
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    fail = [count(F.col("reason") == r, f"fail_{r}") for r in FAILURE_COLUMNS]
    ok = F.col("reason") == "ok"
    reads = observations.groupBy(*SCOPE).agg(F.sum("n").alias("total_reads"), count(ok, "matched_reads"), count(ok & ~F.col("is_rc"), "forward_reads"), count(ok & F.col("is_rc"), "reverse_reads"), *fail)
    part = lambda when, name: F.sum(F.when(when, F.col("read_count")).otherwise(0)).alias(name)
    plain = F.col("category") == "no_indel"
    kinds = kept_alleles.groupBy(*SCOPE).agg(F.sum("read_count").alias("aligned_reads"), part(F.col("category") == "out_of_frame", "out_of_frame"), part(F.col("category") == "in_frame", "in_frame"), part(plain & F.col("has_sub"), "substitution"), part(plain & ~F.col("has_sub"), "unmodified"))
    names = ("aligned_reads", "out_of_frame", "in_frame", "substitution", "unmodified")
    out = reads.join(kinds, list(SCOPE), "left").select(*reads.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return with_breakdown(out)


def missing_guides(config: AnalysisConfig) -> list[tuple[int, int]]:
    """(gene_ix, target_ix) of the targets whose guide isn't in their reference."""
    return [(w.gene_ix, w.target_ix) for w in windows_of(config.genes) if not w.guide_found]


def among(targets: list[tuple[int, int]]) -> Column:
    """Whether a row's target is one of these."""
    each = ((F.col("gene_ix") == g) & (F.col("target_ix") == t) for g, t in targets)
    return reduce(Column.__or__, each, F.lit(False))


def every_target(summary: DataFrame, files: DataFrame, config: AnalysisConfig) -> DataFrame:
    """target_summary() with a row of zeros for each configured target without reads, and error, under which all counts but total_reads are 0.

    files: the column file, once each. For runs with one reference set.
    """
    targets = [F.struct(F.lit(g).alias("gene_ix"), F.lit("normal").alias("kind"), F.lit(t).alias("target_ix")) for g, gene in enumerate(config.genes) for t in range(len(gene.targets))]
    if not targets:
        return summary.withColumn("error", F.lit(None).cast("string"))
    every = files.select("file", F.inline(F.array(*targets)))
    out = every.join(summary, list(SCOPE), "full")
    gone = among(missing_guides(config))
    counts = [c for c in summary.columns if c not in SCOPE]
    zero = lambda c: F.lit(0).cast(summary.schema[c].dataType)
    filled = [F.when(gone & F.lit(c != "total_reads"), zero(c)).otherwise(F.coalesce(c, zero(c))).alias(c) for c in counts]
    return out.select(*SCOPE, *filled, F.when(gone, GUIDE_MISSING).alias("error"))


def with_breakdown(out: DataFrame) -> DataFrame:
    """modified reads, and per cent of aligned reads at two decimals."""
    out = out.withColumn("modified", F.col("out_of_frame") + F.col("in_frame"))
    return out.withColumns({f"{n}_pct": percent(F.col(n), F.col("aligned_reads")) for n in ("modified", "out_of_frame", "in_frame", "substitution", "unmodified")})


def edited_targets(hits: DataFrame, config: AnalysisConfig, config_key: str | None = None) -> DataFrame:
    """file, gene_ix, kind, read_index, target_ix, edited: each hit called where it stands, without a shuffle or a second pass over the reads.

    A read that fails at a target counts there as not edited.
    """
    seen = F.when(F.col("reason") == "ok", F.col("read_window")).alias("read_window")
    own = ["file", "gene_ix", "kind", "read_index", "target_ix", "window", "left_x", "right_x"] + ([config_key] if config_key and config_key != "file" else [])
    edited = F.coalesce(F.col("category") != "no_indel", F.lit(False)).alias("edited")
    return called(hits.select(*own, seen), config, config_key).select("file", "gene_ix", "kind", "read_index", "target_ix", edited)


def multi_target(edits: DataFrame) -> DataFrame:
    """file, gene_ix, kind: evaluated reads and those with 0, 1, 2, 3 or more edited targets, of genes with several targets."""
    per = edits.groupBy("file", "gene_ix", "kind", "read_index").agg(F.sum(F.col("edited").cast("bigint")).alias("edits"), F.count(F.lit(1)).alias("targets")).where("targets > 1")
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    e = F.col("edits")
    return per.groupBy("file", "gene_ix", "kind").agg(F.count(F.lit(1)).alias("evaluated_reads"), n(e == 0, "none"), n(e == 1, "one"), n(e == 2, "two"), n(e >= 3, "three_or_more"))


def co_edits(edits: DataFrame) -> DataFrame:
    """Reads by pair of targets that are both edited; pairs come from each read's own short list, not from a join."""
    per = edits.where("edited").groupBy("file", "gene_ix", "kind", "read_index").agg(F.array_sort(F.collect_list("target_ix")).alias("t")).where(F.size("t") > 1)
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select("file", "gene_ix", "kind", F.explode(pairs).alias("p")).groupBy("file", "gene_ix", "kind", F.col("p.a").alias("target_a"), F.col("p.b").alias("target_b")).agg(F.count(F.lit(1)).alias("n"))


def rescued(calls: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Ambiguous reads with the gene of their best window by whole-read score, and whether its cluster is large enough to rescue."""
    hits = calls.where("outcome = 'ambiguous'").select("file", "read_index", F.explode(F.filter("hits", lambda h: h["reason"] == "ok")).alias("h"))
    order = F.struct((-F.col("h.whole_score")).alias("s"), F.col("h.window").alias("w"))
    best = hits.groupBy("file", "read_index").agg(F.min_by(F.struct("h.gene_ix", F.upper("h.read_window").alias("key")), order).alias("b")).select("file", "read_index", F.col("b.gene_ix").alias("best_gene_ix"), F.col("b.key").alias("key"))
    sizes = best.groupBy("file", "best_gene_ix", "key").agg(F.count(F.lit(1)).alias("cluster"))
    return best.join(sizes, ["file", "best_gene_ix", "key"]).withColumn("rescued", F.col("cluster") >= config.rescue_reads)


def suggestion(calls: DataFrame) -> DataFrame:
    """The window that most reads fit best (then the larger sum of scores): window, votes, score_sum."""
    hits = calls.select("file", "read_index", F.explode(F.filter("hits", lambda h: h["score"].isNotNull())).alias("h"))
    best = hits.groupBy("file", "read_index").agg(F.min_by(F.struct("h.window", "h.score"), F.struct((-F.col("h.score")).alias("s"), F.col("h.window").alias("w"))).alias("b"))
    return best.groupBy(F.col("b.window").alias("window")).agg(F.count(F.lit(1)).alias("votes"), F.sum("b.score").alias("score_sum")).orderBy(F.desc("votes"), F.desc("score_sum"), "window").limit(1)


def first_usable(calls: DataFrame) -> DataFrame:
    """Aligned reads, all reads and the per cent of aligned ones."""
    return calls.agg(F.sum((F.col("outcome") != "filtered").cast("bigint")).alias("aligned"), F.count(F.lit(1)).alias("total")).withColumn("pct", percent(F.col("aligned"), F.col("total")))


__all__ = ["co_edits", "demux_counts", "edited_targets", "failure_counts", "gene_counts", "gene_table", "multi_target", "rescued", "suggestion", "target_summary", "target_table", "with_breakdown"]
