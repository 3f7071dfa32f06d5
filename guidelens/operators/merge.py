"""Merging of results over batches, files and configurations, and curation by exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .alleles import percent, ranked


def with_result_keys(table: DataFrame) -> DataFrame:
    """gene_key (kind and sequence, else name) and target_key (guide, else id) of rows with gene, kind, sequence, guide, target_id."""
    known = lambda c: F.coalesce(F.nullif(F.upper(F.regexp_replace(c, r"\s+", "")), F.lit("")), F.lit(None).cast("string"))
    gene = F.coalesce(F.concat(F.lit("sequence:"), known(F.col("sequence"))), F.concat(F.lit("name:"), F.col("gene")))
    return table.withColumn("gene_key", F.concat_ws(":", "kind", gene)).withColumn("target_key", F.coalesce(known(F.col("guide")), F.col("target_id")))


def merged_alleles(alleles: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Sum of read counts over files or batches by scope and allele; class of the first one seen; ranked anew."""
    first = F.struct("category", "has_sub", "net_indel")
    out = alleles.groupBy(*scope, "read_inner").agg(F.sum("read_count").alias("read_count"), F.min("first_seen").alias("first_seen"), F.min_by(first, "first_seen").alias("f"))
    return ranked(out.select(*scope, "read_inner", "read_count", "first_seen", "f.*"), scope)


def merged_numbers(summaries: DataFrame, keys: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """Null-safe sums of all numbers by key."""
    return summaries.groupBy(*keys).agg(*(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in numbers))


def rollup_files(table: DataFrame, keys: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """Sums by file and over all files; scope is the file's name, or Merged."""
    out = table.groupBy(*keys, F.col("file")).agg(*(F.sum(n).alias(n) for n in numbers))
    both = out.rollup("file", *keys) if not keys else out.groupingSets([[*keys, "file"], [*keys]], *keys, "file")
    mark = F.grouping("file")
    sums = both.agg(mark.alias("_all"), *(F.sum(n).alias(n) for n in numbers))
    return sums.select(*keys, F.when(F.col("_all") == 1, "Merged").otherwise(F.col("file")).alias("scope"), *numbers)


def merged_configs(genes: DataFrame) -> DataFrame:
    """genes (ordinal, gene, sequence) of several configurations: one row a sequence, aliases in order."""
    names = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "gene"))), lambda s: s["gene"])), "/")
    return genes.groupBy("sequence").agg(F.min("ordinal").alias("ordinal"), names.alias("gene"))


def without_files(table: DataFrame, excluded: DataFrame) -> DataFrame:
    return table.join(excluded.select("file"), "file", "left_anti")


def without_genes(table: DataFrame, excluded: DataFrame) -> DataFrame:
    return table.join(excluded.select("gene"), "gene", "left_anti")


def without_targets(table: DataFrame, excluded: DataFrame) -> DataFrame:
    return table.join(excluded.select("gene", "target_id"), ["gene", "target_id"], "left_anti")


def with_excluded(alleles: DataFrame, excluded: DataFrame) -> DataFrame:
    """alleles with excluded: an exclusion (gene, target_id, read_inner) names them."""
    named = excluded.select("gene", "target_id", "read_inner").distinct().withColumn("_named", F.lit(True))
    return alleles.join(named, ["gene", "target_id", "read_inner"], "left").withColumn("excluded", F.coalesce("_named", F.lit(False))).drop("_named")


def curated_ranks(alleles: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Included alleles by falling count, then excluded ones: they stay listed, at the end."""
    by = W.partitionBy(*scope).orderBy("excluded", F.desc("read_count"), "first_seen")
    return alleles.withColumn("group_rank", F.row_number().over(by))


def curated_summary(alleles: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Breakdown from included alleles, and the reads that exclusion takes away."""
    inside, plain = ~F.col("excluded"), F.col("category") == "no_indel"
    part = lambda cond, name: F.sum(F.when(cond, F.col("read_count")).otherwise(0)).alias(name)
    out = alleles.groupBy(*scope).agg(part(inside, "aligned_reads"), part(~inside, "excluded_reads"), part(inside & (F.col("category") == "out_of_frame"), "out_of_frame"), part(inside & (F.col("category") == "in_frame"), "in_frame"), part(inside & plain & F.col("has_sub"), "substitution"), part(inside & plain & ~F.col("has_sub"), "unmodified"))
    out = out.withColumn("modified", F.col("out_of_frame") + F.col("in_frame"))
    return out.withColumn("modified_pct", percent(F.col("modified"), F.col("aligned_reads")))


def curated_totals(summary: DataFrame, excluded_reads: Column) -> DataFrame:
    """Totals less the excluded reads; failures stay as they are."""
    return summary.withColumns({c: F.col(c) - excluded_reads for c in ("total_reads", "matched_reads", "aligned_reads")})


def read_flow(demux: DataFrame) -> DataFrame:
    """scope, raw, usable, assigned, ambiguous of each file and of all."""
    numbers = ("total", "usable", "assigned", "ambiguous")
    return rollup_files(demux, (), numbers)


def numeric_maps_added(maps: DataFrame, key: str, column: str) -> DataFrame:
    """Sum of map columns by key, entry by entry."""
    return maps.select(key, F.explode(column).alias("k", "v")).groupBy(key, "k").agg(F.sum("v").alias("v"))
