"""Reference tables: import, deduplication, overrides for inputs, validation, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Gene, Target
from ..functions.sequence import normalized_sequence

MAX_TARGETS = 10_000  # rows of a reference table, which travels with the functions


def reference_rows(table: DataFrame) -> DataFrame:
    """ordinal, gene, homoeolog_group, sequence, target_id, guide of an imported table; incomplete rows go, columns are found by normalised name."""
    found = {"".join(c.lower().split()).replace("_", "").replace("-", ""): c for c in table.columns}
    pick = lambda name, *ways: next((F.col(f"`{found[w]}`") for w in ways if w in found), F.lit(None)).cast("string").alias(name)
    rows = table.select(pick("ordinal", "ordinal").cast("bigint").alias("ordinal"), pick("gene", "gene", "genename"), pick("homoeolog_group", "homoeologgroup", "homoeolog"), pick("sequence", "sequence", "referencesequence"), pick("target_id", "targetid", "target"), pick("guide", "guide", "sgrna", "sgrnaseq", "sgrnasequence"))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return rows.where(filled(F.col("gene")) & filled(F.col("sequence")) & filled(F.col("guide")))


def reference_payload(rows: DataFrame) -> DataFrame:
    """One gene a distinct sequence (names joined by /), one target a distinct guide, in order of first appearance: reference_ix, gene, display, sequence, target_ix, guide."""
    clean = rows.withColumn("sequence", normalized_sequence(F.col("sequence"))).withColumn("guide", normalized_sequence(F.col("guide")))
    ordered = lambda value: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col(value).alias("v")))), lambda s: s["v"])), "/")
    genes = clean.groupBy("sequence").agg(F.min("ordinal").alias("first"), ordered("gene").alias("display"))
    targets = clean.groupBy("sequence", "guide").agg(F.min("ordinal").alias("at"), F.min_by("target_id", "ordinal").alias("target_id"))
    from pyspark.sql import Window as W

    genes = genes.withColumn("reference_ix", F.row_number().over(W.orderBy("first"))).withColumn("gene", F.concat(F.lit("reference-"), F.col("reference_ix").cast("string")))
    targets = targets.withColumn("target_ix", F.row_number().over(W.partitionBy("sequence").orderBy("at")))
    return genes.join(targets, "sequence").select("reference_ix", "gene", "display", "sequence", "target_ix", "target_id", "guide")


def genes_of(payload: DataFrame, window_size: int = 90) -> tuple[Gene, ...]:
    """The payload as configuration; reference tables are small by nature, and one of more than MAX_TARGETS rows is a ValueError."""
    rows = payload.orderBy("reference_ix", "target_ix").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets in a reference table")
    out: dict[str, Gene] = {}
    for r in rows:
        t = Target(r.target_id or f"target-{r.target_ix}", r.guide, window_size)
        g = out.get(r.gene, Gene(r.gene, r.sequence, (), r.display))
        out[r.gene] = Gene(g.gene, g.sequence, (*g.targets, t), g.display, g.homoeolog_group)
    return tuple(out.values())


def with_config(inputs: DataFrame, overrides: DataFrame) -> DataFrame:
    """inputs (id, name) with config_key: an override for the id, else for the name, else default.

    Overrides may grow with the inputs, so how they are joined is left to their size.
    """
    o = lambda n: overrides.select(F.col("input").alias(n), F.col("config_key").alias(f"{n}_key"))
    both = inputs.join(o("by_id"), F.col("id") == F.col("by_id"), "left").join(o("by_name"), F.col("name") == F.col("by_name"), "left")
    return both.select(*inputs.columns, F.coalesce("by_id_key", "by_name_key", F.lit("default")).alias("config_key"))


def conflicting_genes(rows: DataFrame) -> DataFrame:
    """Genes that have more than one sequence: what a benchmark's validator rejects."""
    return rows.groupBy("gene").agg(F.countDistinct("sequence").alias("sequences")).where("sequences > 1")


def gene_rows(genes: DataFrame) -> DataFrame:
    """genes (gene, homoeolog_group, sequence, targets array) -> one row a target, five columns."""
    return genes.select("gene", "homoeolog_group", "sequence", F.explode_outer("targets").alias("t")).select("gene", "homoeolog_group", "sequence", "t.target_id", "t.guide")


def full_reference_window(windows: DataFrame) -> DataFrame:
    """windows (length, cut, guide_found) -> left and right size that cover every reference; a missing guide raises an error."""
    cut = F.when(F.col("guide_found"), F.col("cut")).otherwise(F.raise_error(F.lit("a guide isn't in its reference")).cast("bigint"))
    return windows.agg(F.max(cut).alias("window_left"), F.max(F.col("length") - cut).alias("window_right"))
