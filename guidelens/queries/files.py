"""FASTQ files written from the reads and read again: in splits, as they arrive, and against a large panel."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnalysisConfig, Gene, Target
from ..kernels.cutsite import windows_of
from ..operators import columns, export, workbooks
from ..operators.assign import assigned
from ..plans.analysis import run_analysis
from ..sources import fastq, splits, workbook
from ..sources.shared import new_path
from ..streaming import alleles as stream
from ..streaming.versions import Versions
from .fixtures import GENE_A, GENE_A90, GENE_B, READS, TRUTH, TWO_GENES, reads, table
from .registry import query


def written_reads(spark, sf_dir) -> str:
    """A folder of FASTQ files with all reads, written by Spark's tasks."""
    folder = new_path(spark, "fastq")
    record = export.fastq_record(F.col("read_id"), F.col("seq"), F.col("qual"), F.col("read_index"))
    reads(spark, sf_dir).repartition(4, "file", "read_index").select(record.alias("value")).write.text(folder)
    return folder


@query(f"{READS} SELECT read_id, seq, qual FROM reads")
def fastq_splits(spark, sf_dir):
    """Every record of every file, whatever tasks read it."""
    return splits.read(spark, [written_reads(spark, sf_dir)]).select("read_id", "seq", "qual")


@query(f"{READS} SELECT count(*) AS records, count(*) AS numbers FROM reads")
def fastq_record_numbers(spark, sf_dir):
    """Records, and what their numbers say they are: each file's run from 0 without a gap."""
    rows = splits.read(spark, [written_reads(spark, sf_dir)])
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("read_index").alias("distinct"), F.max("read_index").alias("last"))
    return files.agg(F.sum("records").alias("records"), F.sum(F.when(F.col("distinct") == F.col("last") + 1, F.col("distinct"))).alias("numbers"))


@query(f"{READS} SELECT read_id, seq, qual FROM reads")
def fastq_whole_files(spark, sf_dir):
    return fastq.read_binary(spark, f"{written_reads(spark, sf_dir)}/part-*").select("read_id", "seq", "qual")


@query(f"{TRUTH} SELECT true_gene AS gene, allele AS read_inner, count(*) AS read_count, any_value(category) AS category, any_value(CAST(true_net AS INT)) AS net_indel FROM truth GROUP BY ALL")
def streamed_alleles(spark, sf_dir):
    """Alleles counted over arriving files, two a batch, from the last version of their counts."""
    state, every = new_path(spark, "counts"), replace(TWO_GENES, indel_percent=0.0)
    stream.started(spark, written_reads(spark, sf_dir), every, state, f"{state}-log", 2, "part-*").awaitTermination()
    rows = stream.result(Versions(spark, state, f"{state}-log").latest(), every)
    return rows.select(F.when(F.col("gene_ix") == 0, "A").otherwise("B").alias("gene"), "read_inner", "read_count", "category", "net_indel")


DECOYS = 500  # windows of a panel beside the two that reads are of


def panel(spark, sf_dir) -> AnalysisConfig:
    """Both genes and up to DECOYS others, made from digests of parts' names: a panel is configuration, and bounded."""
    hexes = F.concat(*(F.md5(F.concat(F.col("p_name"), F.lit(str(k))).cast("binary")) for k in range(4)))
    decoys = table(spark, sf_dir, "part").orderBy("p_partkey").limit(DECOYS).select("p_partkey", F.translate(hexes, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq")).collect()
    return replace(TWO_GENES, genes=(GENE_A, GENE_B, *(Gene(f"d{r.p_partkey}", r.seq, (Target("t", r.seq[50:70]),)) for r in decoys)))


@query(f"{READS} SELECT read_index, CASE WHEN q >= 20 THEN 'assigned' ELSE 'filtered' END AS outcome, CASE WHEN q >= 20 THEN true_gene END AS gene FROM reads")
def panel_assignment(spark, sf_dir):
    """Reads against a panel of hundreds of windows."""
    c = assigned(reads(spark, sf_dir), panel(spark, sf_dir), with_hits=False)
    return c.select("read_index", "outcome", F.when(F.col("gene_ix") == 0, "A").when(F.col("gene_ix") == 1, "B").when(F.col("gene_ix").isNotNull(), "decoy").alias("gene"))


PAGE = 100  # reads that share columns


@query(f"{READS} SELECT read_index, true AS aligned, is_rc, fwd AS from_grid, fwd AS from_columns, true AS as_wide FROM reads")
def viewer_pileup(spark, sf_dir):
    """Reads on their gene's window with what lies before and after it: cells and shared columns both give each read back, and a page's rows are equally wide."""
    by_gene = []
    for name, gene in (("A", GENE_A90), ("B", Gene("B", GENE_B.sequence, (Target("t1", GENE_B.targets[0].guide),)))):
        mine = reads(spark, sf_dir).where(F.col("true_gene") == name).select("read_index", "seq", "file", F.floor(F.col("read_index") / PAGE).alias("page"), F.lit(name).alias("of"))
        by_gene.append(columns.viewer_alignment(mine.repartition("file", "page"), windows_of((gene,))[0]))  # a small file of many reads is one task otherwise
    cells = F.array_join(F.transform("grid", lambda g: F.concat(F.when(g["type"] == "delete", F.lit("")).otherwise(g["base"]), g["insertion"])), "")
    views = by_gene[0].unionByName(by_gene[1]).withColumn("from_grid", F.concat("pre", cells, "post")).drop("seq", "grid")  # cells are dealt with where they are made: they are large
    laid = columns.pileup(views, ["of", "file", "page"]).withColumn("width", F.length("laid") + F.length("lead"))
    widest = F.max("width").over(W.partitionBy("of", "file", "page"))
    bases = F.replace("laid", F.lit("-"), F.lit(""))
    return laid.select("read_index", "aligned", "is_rc", "from_grid", F.concat(F.trim("lead"), bases, "post").alias("from_columns"), (F.col("width") == widest).alias("as_wide"))


_WORKBOOK = "WITH r AS (SELECT concat('nation ', CAST(s_nationkey AS VARCHAR)) AS sheet, s_suppkey, s_name, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier)"


def _supplier_sheets(spark, sf_dir):
    """A reference workbook with a sheet a nation and a target a supplier, written and read again."""
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("ordinal"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("sheet"), F.col("s_suppkey").alias("position"), F.lit("h").alias("homoeolog_group"), F.col("s_name").alias("gene"), F.concat(F.lit("acgt"), k).alias("sequence"), F.concat(F.lit("t"), k).alias("target_id"), F.concat(F.lit("g"), k).alias("guide"))
    path = new_path(spark, "workbook") + ".xlsx"
    workbook.write(workbooks.reference_sheets(rows), path)
    return workbook.read(spark, path)


@query(f"{_WORKBOOK} SELECT sheet, nth + 1 AS ordinal, s_name AS gene, 'h' AS homoeolog_group, concat('ACGT', CAST(s_suppkey AS VARCHAR)) AS sequence, concat('t', CAST(s_suppkey AS VARCHAR)) AS target_id, concat('G', CAST(s_suppkey AS VARCHAR)) AS guide FROM r")
def reference_workbook(spark, sf_dir):
    return workbooks.reference_sheet_rows(_supplier_sheets(spark, sf_dir)).drop("file")


@query(
    f"""{READS}, f AS (SELECT file AS scope, count(*) AS raw, count(*) FILTER (q >= 20) AS usable, count(*) FILTER (q >= 20 AND true_gene = 'A') AS a, count(*) FILTER (q >= 20 AND true_gene = 'B') AS b FROM reads GROUP BY file)
    SELECT scope, raw, usable, usable AS assigned, CAST(2 AS BIGINT) AS targets, a + b AS matched, true AS whole FROM f"""
)
def report_workbook(spark, sf_dir):
    """A report of a run as a workbook, read back from its hidden sheet: each scope's read flow and targets."""
    run = run_analysis(reads(spark, sf_dir), TWO_GENES)
    flow = run.demux.select(F.col("file").alias("scope"), F.col("total").alias("raw"), F.col("usable").alias("phred_passed"), "usable", "assigned")
    gene = F.when(F.col("gene_ix") == 0, "A").otherwise("B").alias("gene")
    pct = [F.round(F.col(c) / F.greatest(F.col("aligned_reads"), F.lit(1)) * 100, 2).alias(f"{name}_pct") for c, name in (("out_of_frame", "out_of_frame"), ("in_frame", "in_frame"), ("unmodified", "no_indel"), ("substitution", "substitution"))]
    targets = run.summary.select(F.col("file").alias("scope"), gene, F.lit("Normal").alias("source"), F.lit("t1").alias("target_id"), "total_reads", "matched_reads", "aligned_reads", *pct)
    path = new_path(spark, "report") + ".xlsx"
    workbook.write(workbooks.report_sheets({"Phred Threshold": 20.0, "Assignment Margin (%)": 2.0}, flow, targets), path)
    cells = workbook.read(spark, path)
    shape = "scope string, readFlow struct<raw:bigint,usable:bigint,assigned:bigint>, targets array<struct<gene:string,matched_reads:bigint>>"
    back = workbooks.report_of(cells).where("scope <> ''").select(F.from_json("json", shape).alias("r"))
    sheets = cells.where("not hidden").select("sheet").distinct()
    rows = back.select("r.scope", "r.readFlow.*", F.size("r.targets").cast("long").alias("targets"), F.aggregate("r.targets", F.lit(0).cast("long"), lambda n, t: n + t["matched_reads"]).alias("matched"))
    return rows.join(sheets, rows["scope"] == sheets["sheet"], "left").select("scope", "raw", "usable", "assigned", "targets", "matched", F.col("sheet").isNotNull().alias("whole"))
