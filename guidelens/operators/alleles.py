"""Observed windows to alleles: grouping, alignment of each group once, threshold and ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import AnalysisConfig
from ..kernels.cutsite import windows_of
from ..kernels.mutate import call, materialized
from .running import with_running

SCOPE = ("file", "gene_ix", "kind", "target_ix")
CALLED = "allele string, category string, has_sub boolean, net_indel int, tokens array<struct<type:string,val:string>>"


def target_hits(calls: DataFrame, kind: str = "normal") -> DataFrame:
    """One row a read and window of the gene(s) it is analysed against: hits exploded, with kind. Columns of the reads that clash with these names go."""
    taken = {"hits", "kind", "gene_ix", "target_ix", "window", "reason", "read_window", "left_x", "right_x", "is_rc", "whole_score", "recovered"}
    keep = [c for c in calls.columns if c not in taken]
    return calls.select(*keep, F.explode("hits").alias("h")).select(*keep, F.lit(kind).alias("kind"), "h.gene_ix", "h.target_ix", "h.window", "h.reason", F.upper("h.read_window").alias("read_window"), "h.left_x", "h.right_x", "h.is_rc", "h.whole_score")


def called(groups: DataFrame, config: AnalysisConfig, config_key: str | None = None) -> DataFrame:
    """groups (window, read_window, left_x, right_x) with the columns of CALLED: one alignment a row, remembered for equal rows of a task. Rows without a read_window have nulls."""
    extra = _parse_datatype_string(CALLED)
    schema = StructType([*groups.schema.fields, *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = {None: windows_of(config.genes)} | {k: windows_of(g) for k, g in config.by_input.items()}
        known: dict[tuple, tuple] = {}
        for batch in batches:
            keys = batch.column(config_key).to_pylist() if config_key else [None] * batch.num_rows
            rows = []
            for key, n, text, left, right in zip(keys, *(batch.column(c).to_pylist() for c in ("window", "read_window", "left_x", "right_x")), strict=True):
                if text is None:
                    rows.append((None,) * len(extra.fields))
                    continue
                ref = refs.get(key, refs[None])[n].ref
                at = (ref, text, left, right)
                if at not in known:
                    if len(known) >= 8192:
                        known.clear()
                    c = call(ref, text, left, right)
                    allele = materialized(ref, c.tokens) if "X" in text else text
                    known[at] = (allele, c.category, c.has_sub, c.net_indel, [{"type": k, "val": v} for k, v in c.tokens])
                rows.append(known[at])
            cols = [pa.array([r[i] for r in rows], arrow.field(f.name).type) for i, f in enumerate(extra.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=arrow)

    return groups.mapInArrow(run, schema)


def observed(hits: DataFrame, config_key: str | None = None) -> DataFrame:
    """Reads (n, and the first of them) by scope and what they observe, or why they observe nothing: all that alleles and summaries need of hits."""
    keys = [*SCOPE, "window", "reason", "is_rc", "read_window", "left_x", "right_x"] + ([config_key] if config_key and config_key not in SCOPE else [])
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("read_index").alias("first"))


def alleles_of(observations: DataFrame, config: AnalysisConfig, config_key: str | None = None) -> DataFrame:
    """file, gene_ix, kind, target_ix, read_inner, read_count, first_seen, category, has_sub, net_indel, tokens.

    The aligner runs once for each distinct observation; then observations whose
    alleles agree are one. Class and tokens are those of the first read seen.
    """
    first = F.struct("category", "has_sub", "net_indel", "tokens")
    groups = called(observations.where("reason = 'ok'"), config, config_key)
    out = groups.groupBy(*SCOPE, F.col("allele").alias("read_inner")).agg(F.sum("n").alias("read_count"), F.min("first").alias("first_seen"), F.min_by(first, "first").alias("f"))
    return out.select(*SCOPE, "read_inner", "read_count", "first_seen", "f.*")


def alleles(hits: DataFrame, config: AnalysisConfig, config_key: str | None = None) -> DataFrame:
    """alleles_of() reads that are grouped by what they observe before any alignment."""
    return alleles_of(observed(hits, config_key), config, config_key)


def kept_and_ranked(table: DataFrame, scope: tuple[str, ...], percent: float, count: str = "read_count", order: str = "first_seen") -> DataFrame:
    """Alleles by falling count (ties by first seen), with group_rank from 1, while each is at least `percent` of the reads kept so far and itself.

    Counts fall and running sums rise, so the share falls and the rows that pass are a
    prefix: a filter on a running sum says the same as stopping at the first failure,
    and their ranks are the ranks among all.
    """
    rows = with_running(table, scope, count, order)
    if percent > 0:
        rows = rows.where(F.col(count) * F.lit(1.0) / F.col("_running") * F.lit(100.0) >= percent)
    return rows.select(*table.columns, F.col("_rank").alias("group_rank"))


def kept(table: DataFrame, scope: tuple[str, ...], percent: float, count: str = "read_count", order: str = "first_seen") -> DataFrame:
    """The alleles of kept_and_ranked() without their ranks."""
    return kept_and_ranked(table, scope, percent, count, order).drop("group_rank") if percent > 0 else table


def ranked(table: DataFrame, scope: tuple[str, ...], count: str = "read_count", order: str = "first_seen") -> DataFrame:
    """group_rank 1.. by falling count, ties by first seen."""
    return kept_and_ranked(table, scope, 0, count, order)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded half up; 0 when there is nothing."""
    scale = float(10**digits)
    return F.when(whole > 0, F.floor(part * F.lit(1.0) / whole * F.lit(100.0 * scale) + 0.5) / F.lit(scale)).otherwise(F.lit(0.0))
