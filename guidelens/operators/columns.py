"""Rows aligned to one reference, laid on shared columns: copies of a gene on their anchor, reads of a page on their window.

Every row has tokens over the reference (equal, substitute, delete, unobserved and
insert, as calls have them), so it has one base or gap for each reference column and
bases inserted at borders between columns. The longest insertion at each border, over
the rows of a group, is how many columns open there for all; it is one aggregation, and
each row is laid by itself after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..kernels.cutsite import Window
from ..kernels.locate import Evidence, best_evidence, candidates, segments
from ..kernels.matching import opcodes, reverse_complement
from ..kernels.mutate import call, window_grid
from ..kernels.pairwise import homoeolog_similarity
from ..sources.shared import written
from .homoeolog import LANE_IDENTITY, with_anchor

CACHE = 4096

TOKENS = "array<struct<type:string,val:string>>"
GRID = "array<struct<base:string,type:string,insertion:string>>"
VIEW = f"aligned boolean, reason string, category string, has_sub boolean, net_indel int, is_rc boolean, pre string, post string, tokens {TOKENS}, grid {GRID}"


def tokens_of(read: str, ref: str) -> list[tuple[str, str]]:
    """Runs of an alignment of read to ref; a replacement's surplus is inserted after it, or deleted."""
    out = []
    for tag, i1, i2, j1, j2 in opcodes(read, ref):
        if tag == "equal":
            out.append(("equal", read[i1:i2]))
            continue
        both = min(i2 - i1, j2 - j1)
        parts = (("substitute", read[i1 : i1 + both]), ("insert", read[i1 + both : i2]), ("delete", ref[j1 + both : j2]))
        out += [(kind, bases) for kind, bases in parts if bases]
    return out


def _with(df: DataFrame, extra: str, used: tuple[str, ...], one) -> DataFrame:
    """df and what one() makes of the used columns of each row; equal values in a batch are one call, and CACHE of them are remembered a task."""
    more = _parse_datatype_string(extra)
    schema = StructType([*df.schema.fields, *more.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = lru_cache(CACHE)(one)
        for batch in batches:
            number: dict[tuple, int] = {}
            at = pa.array([number.setdefault(v, len(number)) for v in zip(*(batch.column(c).to_pylist() for c in used), strict=True)], pa.int32())
            rows = [remembered(*values) for values in number]
            cols = [pa.array([r[i] for r in rows], arrow.field(f.name).type).take(at) for i, f in enumerate(more.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=arrow)

    return df.mapInArrow(run, schema)


def _spread(tokens: Column) -> tuple[Column, Column]:
    """One base, gap (-) or X for each reference column, and (border, bases) of each insertion."""
    zero = F.named_struct(F.lit("bases"), F.lit(""), F.lit("inserts"), F.array().cast("array<struct<border:int,bases:string>>"))

    def step(s: Column, t: Column) -> Column:
        shown = F.when(t["type"] == "delete", F.repeat(F.lit("-"), F.length(t["val"]))).when(t["type"] == "unobserved", F.repeat(F.lit("X"), F.length(t["val"]))).otherwise(t["val"])
        inserted = F.array(F.named_struct(F.lit("border"), F.length(s["bases"]), F.lit("bases"), t["val"]))
        is_insert = t["type"] == "insert"
        return F.named_struct(F.lit("bases"), F.when(is_insert, s["bases"]).otherwise(F.concat(s["bases"], shown)), F.lit("inserts"), F.when(is_insert, F.concat(s["inserts"], inserted)).otherwise(s["inserts"]))

    whole = F.aggregate(tokens, zero, step)
    return whole["bases"], whole["inserts"]


def on_shared_columns(rows: DataFrame, group: list[str], tokens: str = "tokens") -> DataFrame:
    """rows with `laid`: each row's bases on the columns of its group, - where it has none.

    Rows without tokens have a null. A group is the copies of one gene, or a page. Rows
    are read twice, so those that are dear to make should be written first.
    """
    bases, inserts = _spread(F.col(tokens))
    spread = rows.withColumn("_bases", bases).withColumn("_inserts", inserts)
    at = spread.select(*(F.col(g).alias(f"_of_{i}") for i, g in enumerate(group)), F.explode("_inserts").alias("i"))
    names = [f"_of_{i}" for i in range(len(group))]
    widest = at.groupBy(*names, F.col("i.border").alias("border")).agg(F.max(F.length("i.bases")).alias("width"))
    opened = widest.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("border", "width"))).alias("_opened"))
    same = F.lit(True)
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    met = spread.withColumn("_held", F.map_from_entries("_inserts")).drop("_inserts").join(opened, same, "left")
    size, all_opened = F.length("_bases"), F.coalesce("_opened", F.array().cast("array<struct<border:int,width:int>>"))
    until = lambda k: F.least(F.coalesce(F.get(F.col("_opened"), k)["border"], size), size)
    # from one border with columns to the next: what is inserted there, and the bases after it
    one = lambda o, k: F.concat(F.rpad(F.coalesce(F.element_at("_held", o["border"]), F.lit("")), o["width"], F.lit("-")), F.substring(F.col("_bases"), o["border"] + 1, until(k + 1) - o["border"]))
    pieces = F.transform(F.filter(all_opened, lambda o: o["border"] <= size), one)
    laid = F.concat(F.substring(F.col("_bases"), F.lit(1), until(F.lit(0))), F.array_join(pieces, ""))
    return met.select(*rows.columns, F.when(F.col("_bases").isNotNull(), laid).alias("laid"))


def star_alignment(refs: DataFrame, group: str = "homoeolog_group") -> DataFrame:
    """group, gene_ix, is_anchor, similarity, aligned, tokens, laid: every copy on its group's anchor, on columns that all copies share.

    refs: group, gene_ix, sequence. Copies less alike than a lane needs have no tokens and open no columns.
    """
    clean = refs.select(group, "gene_ix", F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"))
    lanes = with_anchor(clean.where(F.length("sequence") > 0), group)

    def one(ref: str, anchor: str, ix: int, anchor_ix: int) -> tuple:
        alike = homoeolog_similarity(ref, anchor)
        aligned = ix == anchor_ix or alike >= LANE_IDENTITY
        return alike, aligned, [{"type": k, "val": v} for k, v in tokens_of(ref, anchor)] if aligned else None

    rows = _with(lanes, f"similarity double, aligned boolean, tokens {TOKENS}", ("sequence", "anchor_seq", "gene_ix", "anchor_ix"), one)
    laid = on_shared_columns(written(rows, "lanes"), [group])
    return laid.select(group, "gene_ix", (F.col("gene_ix") == F.col("anchor_ix")).alias("is_anchor"), "similarity", "aligned", "tokens", "laid")


DIFFERENCE = "array<struct<tag:string,ref_from:int,ref_to:int,anchor_from:int,anchor_to:int>>"
LEAST_WIDTH = 0.55  # fixed value: per cent of the lane that a mark takes at least


def lane_differences(refs: DataFrame, group: str = "homoeolog_group") -> DataFrame:
    """group, gene_ix, tag, ref_from, ref_to, anchor_from, anchor_to, left_pct, width_pct, label: where each aligned copy differs from its anchor."""
    clean = refs.select(group, "gene_ix", F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"))
    lanes = with_anchor(clean.where(F.length("sequence") > 0), group).where("gene_ix <> anchor_ix")

    def one(ref: str, anchor: str) -> tuple:
        if homoeolog_similarity(ref, anchor) < LANE_IDENTITY:
            return ([],)
        return ([{"tag": t, "ref_from": i1, "ref_to": i2, "anchor_from": j1, "anchor_to": j2} for t, i1, i2, j1, j2 in opcodes(ref, anchor) if t != "equal"],)

    rows = _with(lanes, f"found {DIFFERENCE}", ("sequence", "anchor_seq"), one).select(group, "gene_ix", F.length("anchor_seq").alias("n"), F.explode("found").alias("d")).select(group, "gene_ix", "n", "d.*")
    share = lambda c: c * F.lit(1.0) / F.greatest(F.col("n"), F.lit(1)) * F.lit(100.0)
    label = F.format_string("%s · ref %d-%d · alignment %d-%d", F.col("tag"), F.col("ref_from") + 1, F.col("ref_to"), F.col("anchor_from") + 1, F.col("anchor_to"))
    left, width = F.greatest(F.lit(0.0), F.least(F.lit(100.0), share(F.col("anchor_from")))), F.greatest(F.lit(LEAST_WIDTH), share(F.col("anchor_to") - F.col("anchor_from")))
    return rows.select(group, "gene_ix", "tag", "ref_from", "ref_to", "anchor_from", "anchor_to", left.alias("left_pct"), width.alias("width_pct"), label.alias("label"))


def viewed(seq: str, window: Window) -> tuple:
    """VIEW of one read: qualities don't matter here."""
    upper = (seq or "").upper()
    found, reasons = candidates(upper, window)
    e = best_evidence(upper, found, [True] * len(found), reasons)
    if not isinstance(e, Evidence):
        return False, e, None, None, None, None, seq, "", None, []
    oriented = reverse_complement(seq) if e.is_rc else seq
    c = call(window.ref, e.read_window, e.left_x, e.right_x)
    if len(segments(upper)) > 1:
        seen = upper  # mates that didn't meet: the whole read is what is observed
    else:
        seen = e.read_window[e.left_x : len(e.read_window) - e.right_x]
    at = oriented.upper().find(seen) if seen else 0
    if at >= 0:
        pre, post = oriented[:at], oriented[at + len(seen or oriented) :]
    else:  # the observation isn't one piece of the read: where it would be
        middle = max(0, len(oriented) // 2 - window.cut)
        pre, post = oriented[:middle], oriented[min(len(oriented), middle + len(window.ref)) :]
    tokens = [{"type": k, "val": v} for k, v in c.tokens]
    return True, None, c.category, c.has_sub, c.net_indel, e.is_rc, pre, post, tokens, [dict(zip(("base", "type", "insertion"), x, strict=True)) for x in window_grid(c.tokens, len(window.ref))]


def viewer_alignment(reads: DataFrame, window: Window) -> DataFrame:
    """reads (seq, ...) with the columns of VIEW: the window located in each read on either strand, what lies before and after it, and its cells.

    Reads that don't align have a reason, themselves as pre, and no cells.
    """
    return _with(reads, VIEW, ("seq",), lambda seq: viewed(seq, window))


def pileup(views: DataFrame, page: list[str]) -> DataFrame:
    """views with laid, and lead: what precedes the window, padded to the longest of the page; unaligned reads have nulls. The views are written once and read again."""
    views = written(views, "views")
    laid = on_shared_columns(views, page)
    names = [f"_of_{i}" for i in range(len(page))]
    longest = views.where("aligned").groupBy(*(F.col(g).alias(n) for g, n in zip(page, names, strict=True))).agg(F.max(F.length("pre")).alias("_most"))
    same = F.lit(True)
    for g, n in zip(page, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    lead = F.when(F.col("aligned"), F.lpad("pre", F.col("_most"), F.lit(" ")))
    return laid.join(longest, same, "left").select(*laid.columns, lead.alias("lead"))
