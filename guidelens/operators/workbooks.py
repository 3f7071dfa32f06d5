"""Reference tables and reports as workbooks: what their sheets hold, and back.

A reference workbook has a sheet for the default configuration and one for each input
with its own. A report has a sheet for each scope and a hidden one with everything as
JSON in pieces, which is what an import reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import normalized_barcode
from ..sources.shared import written
from ..sources.workbook import cell, number

#: Header names (without anything but letters and digits) by column, and the column where none has one of them.
COLUMNS = {"gene": (("genename", "reference", "referencename"), 1), "sequence": (("genesequence", "referencesequence"), 2), "target_id": (("targetname",), 3), "guide": (("grnasequence", "targetsequence"), 4)}
GROUP = ("homoeolog", "homoeologname")
HEADER = ("Homoeolog", "Gene Name", "Gene Sequence", "Target Name", "gRNA Sequence")
DEFAULTS = ("default", "references", "reference")
METADATA, PIECE = ".metadata", 30_000


def reference_sheet_rows(cells: DataFrame) -> DataFrame:
    """file, sheet, ordinal, gene, homoeolog_group, sequence, target_id, guide of sheets read by workbook.read().

    A column is found by its header, else by its place: gene, sequence, target, guide
    from the first column on, or from the second where a sheet has groups. Of equal
    headers the last counts. Rows without a gene, sequence or guide go, and so do
    sheets without a first row.
    """
    clean = F.transform("cells", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    heads = cells.where("row = 1").select("file", "sheet", clean.alias("head"))

    def last(name: str) -> Column:
        at = F.array_position(F.reverse("head"), name)
        return F.when(at > 0, F.size("head") - at + 1)

    group = F.coalesce(*(last(n) for n in GROUP))
    shift = F.when(group.isNotNull(), 1).otherwise(0)
    places = {c: F.coalesce(*(last(n) for n in names), F.lit(place) + shift) for c, (names, place) in COLUMNS.items()}
    found = heads.select("file", "sheet", group.alias("_group"), *(p.alias(f"_{c}") for c, p in places.items()))
    rows = cells.where("row > 1").select("file", "sheet", F.col("row").alias("ordinal"), "cells").join(found, ["file", "sheet"])
    text = lambda c: F.trim(F.coalesce(F.get("cells", (F.col(c) - 1).cast("int")), F.lit("")))
    bases = lambda c: F.upper(F.regexp_replace(text(c), r"\s+", ""))
    out = rows.select("file", "sheet", F.col("ordinal").cast("long").alias("ordinal"), text("_gene").alias("gene"), F.when(F.col("_group").isNotNull(), text("_group")).otherwise("").alias("homoeolog_group"), bases("_sequence").alias("sequence"), text("_target_id").alias("target_id"), bases("_guide").alias("guide"))
    return out.where("gene <> '' and sequence <> '' and guide <> ''")


def with_roles(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows of reference sheets with config_key: default for the only sheet or one of DEFAULTS, an input's key by its aliases (alias, config_key), null for sheets of no input."""
    sheets = rows.select("file", "sheet").distinct()
    sheets = sheets.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("file"))).withColumn("_name", normalized_barcode(F.col("sheet")))
    known = aliases.select(normalized_barcode(F.col("alias")).alias("_name"), "config_key").groupBy("_name").agg(F.max("config_key").alias("_key"))
    key = F.when((F.col("n") == 1) | F.col("_name").isin(*DEFAULTS), F.lit("default")).otherwise(F.col("_key"))
    return rows.join(sheets.join(known, "_name", "left").select("file", "sheet", key.alias("config_key")), ["file", "sheet"])


def reference_sheets(rows: DataFrame) -> DataFrame:
    """Sheet rows of reference rows (ordinal of the sheet, sheet, position, homoeolog_group, gene, sequence, target_id, guide): a header and a row a target."""
    heads = rows.select("ordinal", "sheet").distinct().select("ordinal", "sheet", F.lit(1).alias("row"), F.array(*(cell(h) for h in HEADER)).alias("cells"))
    at = F.row_number().over(W.partitionBy("ordinal").orderBy("position")) + 1  # a sheet's rows, which the format bounds
    body = rows.select("ordinal", "sheet", at.alias("row"), F.array(*(cell(F.coalesce(c, F.lit(""))) for c in ("homoeolog_group", "gene", "sequence", "target_id", "guide"))).alias("cells"))
    return heads.unionByName(body).select("ordinal", "sheet", F.lit(False).alias("hidden"), "row", "cells")


def report_sheets(params: dict[str, str | float], flow: DataFrame, targets: DataFrame) -> DataFrame:
    """Sheet rows of a report.

    params: what section 1 shows. flow: scope, raw, phred_passed, usable, assigned.
    targets: scope, gene, source, target_id, total_reads, aligned_reads, and four
    shares in per cent: out_of_frame_pct, in_frame_pct, no_indel_pct, substitution_pct.
    A scope's sheet has the parameters, the read flow, and the classes of each target;
    sheets are in the order of their names, and a last, hidden one has the whole report.
    flow and targets, which several parts of the sheets read, are written first.
    """
    flow, targets = written(flow, "flow"), written(targets, "targets")
    place = F.dense_rank().over(W.orderBy("scope")).alias("ordinal")  # scopes of one report: its input files and their total
    scopes = flow.select("scope", F.regexp_replace("scope", r"[\\/*?\[\]:]", "_").substr(1, 31).alias("sheet"), place)
    numbered_targets = targets.withColumn("nth", F.row_number().over(W.partitionBy("scope").orderBy("gene", "source", "target_id"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("scope")))

    def fixed(row: int, *cells: Column) -> Column:
        return F.struct(F.lit(row).alias("row"), F.array(*cells).alias("cells"))

    pairs = [fixed(1, cell("1. Analysis Parameters"))] + [fixed(2 + i, cell(k), number(v) if isinstance(v, int | float) else cell(v)) for i, (k, v) in enumerate(params.items())]
    at = len(params) + 3
    flows = (("Raw Reads", "raw"), ("Phred Passed", "phred_passed"), ("Usable for Assignment", "usable"), ("Assigned Reads", "assigned"))
    pairs += [fixed(at, cell("2. Read Flow Summary"))] + [fixed(at + 1 + i, cell(k), number(F.col(c))) for i, (k, c) in enumerate(flows)]
    at += len(flows) + 2
    pairs += [fixed(at, cell("3. Per-Class Summary")), fixed(at + 1, *(cell(h) for h in ("Gene", "Source", "Target", "Total Reads", "Aligned Reads")))]
    top = flow.join(scopes, "scope").select("ordinal", "sheet", F.inline(F.array(*pairs)))
    at += 2
    with_sheet = numbered_targets.join(scopes, "scope")
    totals = with_sheet.select("ordinal", "sheet", (F.col("nth") + (at - 1)).alias("row"), F.array(cell(F.col("gene")), cell(F.col("source")), cell(F.col("target_id")), number(F.col("total_reads")), number(F.col("aligned_reads"))).alias("cells"))
    heads = with_sheet.where("nth = 1").select("ordinal", "sheet", (F.col("n") + (at + 1)).cast("int").alias("row"), F.array(*(cell(h) for h in ("Gene", "Out-of-frame %", "In-frame %", "No Indel %", "Substitution %"))).alias("cells"))
    shares = with_sheet.select("ordinal", "sheet", (F.col("n") + F.col("nth") + (at + 1)).cast("int").alias("row"), F.array(cell(F.col("gene")), *(number(F.col(c) / 100) for c in ("out_of_frame_pct", "in_frame_pct", "no_indel_pct", "substitution_pct"))).alias("cells"))
    shown = top.unionByName(totals).unionByName(heads).unionByName(shares).select("ordinal", "sheet", F.lit(False).alias("hidden"), "row", "cells")
    return shown.unionByName(metadata_rows(params, flow, targets))


def metadata_rows(params: dict[str, str | float], flow: DataFrame, targets: DataFrame) -> DataFrame:
    """The hidden sheet: the report as JSON, a scope a line, each in pieces of PIECE characters; the first line is the parameters."""
    own = [c for c in targets.columns if c != "scope"]
    lists = targets.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("gene", "source", "target_id", *(c for c in own if c not in ("gene", "source", "target_id"))))).alias("targets"))
    whole = flow.join(lists, "scope", "left").select("scope", F.to_json(F.struct("scope", F.struct(*(c for c in flow.columns if c != "scope")).alias("readFlow"), "targets")).alias("json"))
    first = flow.sparkSession.range(1).select(F.lit("").alias("scope"), F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in params.items()))).alias("json"))
    texts = first.unionByName(whole)
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("json") / PIECE).cast("int") - 1), lambda i: F.substring(F.col("json"), i * PIECE + 1, F.lit(PIECE)))
    each = texts.select("scope", F.posexplode(pieces).alias("piece", "text"))
    row = F.row_number().over(W.orderBy("scope", "piece"))  # the pieces of one report
    return each.select(F.lit(1 << 20).alias("ordinal"), F.lit(METADATA).alias("sheet"), F.lit(True).alias("hidden"), row.alias("row"), F.array(cell(F.col("scope")), cell(F.col("piece").cast("string")), cell(F.col("text"))).alias("cells"))


def report_of(cells: DataFrame) -> DataFrame:
    """file, scope, json of a report's hidden sheet; the parameters have scope ''. Workbooks without that sheet have none."""
    rows = cells.where(F.col("sheet") == METADATA).select("file", F.col("cells")[0].alias("scope"), F.col("cells")[1].cast("int").alias("piece"), F.col("cells")[2].alias("text"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda s: s["text"])
    return rows.groupBy("file", "scope").agg(F.array_join(pieces, "").alias("json"))
