"""Similar gene copies: rates, co-editing under independence, shared alleles, windows side by side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.cutsite import find_homoeolog_site
from ..kernels.pairwise import compare_references, difference_bp, homoeolog_similarity, project_position

LANE_IDENTITY = 45.0  # per cent at which windows share a lane of the overview
CACHE = 4096  # guides and sequences that a task remembers
MAX_WINDOWS = 1000  # that are compared side by side
RATES = {"all": "modified_pct", "oof": "out_of_frame_pct", "inframe": "in_frame_pct", "sub": "substitution_pct"}


def rate(filter_name: str) -> F.Column:
    """The rate column that a mutation filter stands for."""
    return F.col(RATES.get(filter_name, RATES["all"]))


def editing_spread(rows: DataFrame, group: str, rate_column: str = "rate") -> DataFrame:
    """mean, spread (largest less smallest) and reads of each group."""
    return rows.groupBy(group).agg(F.avg(rate_column).alias("mean_rate"), (F.max(rate_column) - F.min(rate_column)).alias("spread"), F.sum("aligned_reads").alias("reads"))


def coedit_independence(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Chances in per cent that all, none, one or more, and some but not all copies are edited, if copies are edited independently; parity and bias of the rates. A copy alone is never edited in part."""
    e = F.transform(F.transform(F.array_sort(F.collect_list(F.struct(order, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("rate"))).alias("r")))), lambda s: s["r"]), lambda r: r / 100.0)
    product = lambda xs: F.aggregate(xs, F.lit(1.0), lambda a, x: a * x)
    per = rows.groupBy(group).agg(e.alias("e"), F.max("rate").alias("hi"), F.min("rate").alias("lo"))
    none = product(F.transform("e", lambda x: 1.0 - x))
    one, two = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    single = F.when(F.size("e") == 2, one * (1.0 - two) + two * (1.0 - one)).otherwise(F.greatest(F.lit(0.0), 1.0 - none - product(F.col("e"))))
    return per.select(group, (product(F.col("e")) * 100.0).alias("p_both"), (none * 100.0).alias("p_none"), ((1.0 - none) * 100.0).alias("p_at_least_one"), (single * 100.0).alias("p_single"), F.when(F.col("hi") > 0, F.col("lo") / F.col("hi") * 100.0).otherwise(100.0).alias("parity"), F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).when(F.col("hi") > 0, 999.0).otherwise(1.0).alias("bias"))


def shared_alleles(rows: DataFrame, genes: int, most: int = 15) -> DataFrame:
    """Alleles by class and net change: largest share of each gene, mean over all genes; those of several genes first, a list of `most`."""
    key = F.concat(F.col("classification"), F.lit(" ["), F.when(F.col("net_indel") >= 0, "+").otherwise(""), F.col("net_indel").cast("string"), F.lit("bp]"))
    per = rows.where("read_inner <> ''").withColumn("allele_key", key).groupBy("allele_key", "gene").agg(F.max("read_pct").alias("pct"))
    out = per.groupBy("allele_key").agg((F.count(F.lit(1)) > 1).alias("shared"), (F.sum("pct") / float(genes)).alias("mean_pct"))
    return out.orderBy(F.desc("shared"), F.desc("mean_pct"), "allele_key").limit(most)


def window_pairs(windows: DataFrame) -> DataFrame:
    """Every pair (ix, seq) of a list of windows, each once; window lists are configuration, and one of more than MAX_WINDOWS is a ValueError."""
    if windows.limit(MAX_WINDOWS + 1).count() > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows side by side")
    a, b = windows.select(F.col("ix").alias("a"), F.col("seq").alias("a_seq")), windows.select(F.col("ix").alias("b"), F.col("seq").alias("b_seq"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


def similarity(pairs: DataFrame) -> DataFrame:
    """pairs with identity (least edits) and ratio (matching blocks) in per cent at one decimal, difference_bp, and aligned: alike enough for one lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column("a_seq").to_pylist(), batch.column("b_seq").to_pylist(), strict=True))
            yield batch.append_column("identity", pa.array([compare_references(x, y)[0] for x, y in both], pa.float64())).append_column("ratio", pa.array([homoeolog_similarity(x, y) for x, y in both], pa.float64())).append_column("difference_bp", pa.array([difference_bp(x, y) for x, y in both], pa.int32()))

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    found = pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("identity", DoubleType()), StructField("ratio", DoubleType()), StructField("difference_bp", IntegerType())]))
    return found.withColumn("aligned", F.col("identity") >= LANE_IDENTITY)


LANE = "similarity double, guide_from int, guide_to int, window_from int, window_to int, window_difference_bp int"


def with_anchor(refs: DataFrame, group: str = "homoeolog_group") -> DataFrame:
    """refs (group, gene_ix, sequence) with anchor_ix and anchor_seq: the longest reference of the group, the first of equal ones. A group is the copies of one gene, which is configuration."""
    order = F.struct((-F.length("sequence")).alias("size"), F.col("gene_ix").alias("ix"))
    best = refs.where(F.length("sequence") > 0).groupBy(group).agg(F.min_by(F.struct("gene_ix", "sequence"), order).alias("_a"))
    return refs.join(best, group).select(*refs.columns, F.col("_a.gene_ix").alias("anchor_ix"), F.col("_a.sequence").alias("anchor_seq"))


def markers(refs: DataFrame, windows: DataFrame, group: str = "homoeolog_group") -> DataFrame:
    """Every reference of a group with every target that any of its copies has: where its guide and window lie on the group's anchor.

    refs: group, gene_ix, sequence. windows: gene_ix, target_id, cut (below 0: none),
    guide_from, guide_to, window_from, window_to, window_seq, error; one row a gene and
    target. Result: group, gene_ix, is_anchor, target_id, similarity, aligned, the four
    places on the anchor (null where there are none), left_pct (the guide's middle in
    per cent of the anchor), window_difference_bp against the anchor's window, error.
    A gene without a group is one of its own, one without a sequence has no markers, and
    one without a window for a target has a row with an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    named = F.coalesce(F.nullif(F.trim(F.col(group)), F.lit("")), F.concat(F.lit("Homoeolog "), (F.col("gene_ix") + 1).cast("string")))
    clean = refs.select(named.alias(group), "gene_ix", F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"))
    lanes = with_anchor(clean.where(F.length("sequence") > 0), group)
    targets = lanes.select(group, "gene_ix").join(windows.select("gene_ix", "target_id"), "gene_ix").select(group, "target_id").distinct()
    own = windows.select("gene_ix", "target_id", "cut", "guide_from", "guide_to", "window_from", "window_to", "window_seq", F.col("error").alias("cause"))
    theirs = windows.select(F.col("gene_ix").alias("anchor_ix"), "target_id", F.col("window_seq").alias("anchor_window"))
    rows = lanes.join(targets, group).join(own, ["gene_ix", "target_id"], "left").join(theirs, ["anchor_ix", "target_id"], "left")
    spots = ("guide_from", "guide_to", "window_from", "window_to")
    rows = rows.withColumnsRenamed({c: f"own_{c}" for c in spots})
    used = ("sequence", "anchor_seq", *(f"own_{c}" for c in spots), "window_seq", "anchor_window")
    extra = _parse_datatype_string(LANE)
    schema = StructType([*rows.schema.fields, *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ref, anchor, *at, window, other in zip(*(batch.column(c).to_pylist() for c in used), strict=True):
                places = [None if p is None else project_position(ref, anchor, p) for p in at]
                found.append((homoeolog_similarity(ref, anchor), *places, None if window is None or other is None else difference_bp(window, other)))
            cols = [pa.array([r[i] for r in found], arrow.field(f.name).type) for i, f in enumerate(extra.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=arrow)

    out = rows.mapInArrow(run, schema)
    is_anchor = F.col("gene_ix") == F.col("anchor_ix")
    aligned = is_anchor | (F.col("similarity") >= LANE_IDENTITY)
    shows = aligned & (F.coalesce("cut", F.lit(-1)) >= 0)
    middle = (F.col("guide_from") + F.col("guide_to")) / 2.0
    placed = lambda c: F.when(shows, F.col(c)).alias(c)
    error = F.when(~aligned, F.format_string("Reference alignment %.1f%%", F.col("similarity"))).when(~shows, F.coalesce("cause", F.lit("Guide not matched"))).when(middle.isNull(), "Alignment position unavailable")
    return out.select(group, "gene_ix", is_anchor.alias("is_anchor"), "target_id", "similarity", aligned.alias("aligned"), *map(placed, spots), F.when(shows, F.least(F.lit(100.0), middle / F.length("anchor_seq") * 100.0)).alias("left_pct"), placed("window_difference_bp"), error.alias("error"))


SITE = "matched boolean, exact boolean, mismatches int, identity double, strand string, start int, end int, cut int, pam string, pam_found boolean, spacer string, guide string"


def guide_sites(rows: DataFrame, allowed: float = 0.25) -> DataFrame:
    """rows (sequence, query) with the columns of SITE: the guide's place in a similar reference."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(SITE)
    schema = StructType([*rows.schema.fields, *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = lru_cache(CACHE)(lambda sequence, query: find_homoeolog_site(sequence, query, allowed))
        for batch in batches:
            number: dict[tuple, int] = {}  # equal rows of a batch are one
            at = pa.array([number.setdefault(v, len(number)) for v in zip(batch.column("sequence").to_pylist(), batch.column("query").to_pylist(), strict=True)], pa.int32())
            found = [remembered(*v) for v in number]
            cols = [pa.array([getattr(m, f.name) for m in found], arrow.field(f.name).type).take(at) for f in extra.fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=arrow)

    return rows.mapInArrow(run, schema)
