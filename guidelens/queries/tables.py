"""Names, labels, reference tables, exclusions and nested results, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequence as S
from ..operators import export, homoeolog, merge, references, summary
from ..operators.alleles import ranked
from ..operators.assign import assigned
from .fixtures import READS, TWO_TARGETS, reads, table
from .registry import query
from .results import _EXCLUDED, _MERGED, ALLELES, PCT, _flagged, allele_table, calls


@query(f"{READS} SELECT read_index, CAST(unnest(list_filter(range(0, length(seq) - 1), lambda p: substring(seq, CAST(p AS INT) + 1, 2) = 'TT')) AS INT) AS position FROM reads")
def exact_positions(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", F.explode(S.positions(F.col("seq"), "TT")).alias("position"))


@query(f"{READS} SELECT read_index, regexp_replace(seq, '(GA[ACGT]TC)', '<mark>\\1</mark>', 'g') AS shown FROM reads")
def highlighted_motif(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.highlighted(F.col("seq"), "GANTC").alias("shown"))


def _one_of(values: tuple[str, ...], k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Out-of-frame' WHEN 1 THEN 'In-frame' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'Substitution' ELSE 'No indel' END END AS label,
    CASE l_suppkey % 5 WHEN 0 THEN 'Low quality' WHEN 1 THEN 'No anchor' WHEN 2 THEN 'Cut site not covered' WHEN 3 THEN 'No alignment' ELSE 'No target window' END AS failure FROM lineitem"""
)
def display_labels(spark, sf_dir):
    category = _one_of(("out_of_frame", "in_frame", "no_indel"), F.col("l_linenumber"))
    reason = _one_of(("quality", "no_anchor", "no_coverage", "no_alignment", "no_target_window"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", names.display_class(category, F.col("l_partkey") % 2 == 0).alias("label"), names.failure_label(reason).alias("failure"))


@query("SELECT p_partkey, CAST(length(substring(p_name, 1, 3)) + length(p_brand) AS INT) AS inserted, CAST(length(substring(p_type, 1, 5)) AS INT) AS deleted FROM part")
def token_lengths(spark, sf_dir):
    token = lambda kind, val: F.struct(F.lit(kind).alias("type"), val.alias("val"))
    tokens = F.array(token("ins", F.substring("p_name", 1, 3)), token("del", F.substring("p_type", 1, 5)), token("ins", F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", S.token_length(tokens, "ins").alias("inserted"), S.token_length(tokens, "del").alias("deleted"))


@query("SELECT s_suppkey, CAST(s_suppkey % 97 AS DOUBLE) AS all_rate, CAST(s_suppkey % 31 AS DOUBLE) AS oof_rate, CAST(s_suppkey % 37 AS DOUBLE) AS inframe_rate, CAST(s_suppkey % 11 AS DOUBLE) AS sub_rate, CAST(s_suppkey % 97 AS DOUBLE) AS other_rate FROM supplier")
def mutation_rates(spark, sf_dir):
    figures = {"modified_pct": 97, "out_of_frame_pct": 31, "in_frame_pct": 37, "substitution_pct": 11}
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", *((F.col("s_suppkey") % k).cast("double").alias(c) for c, k in figures.items()))
    return rows.select("s_suppkey", *(homoeolog.rate(x).alias(f"{x}_rate") for x in ("all", "oof", "inframe", "sub", "other")))


@query(f"{ALLELES} SELECT file, gene, read_inner, read_count FROM alleles WHERE gene <> 'B'")
def curate_genes(spark, sf_dir):
    out = spark.range(1).select(F.lit("B").alias("gene"))
    return merge.without_genes(allele_table(spark, sf_dir), out).select("file", "gene", "read_inner", "read_count")


@query(f"{ALLELES} SELECT file, gene, read_inner, read_count FROM alleles WHERE gene <> 'A'")
def curate_targets(spark, sf_dir):
    out = spark.createDataFrame([("A", "t1"), ("B", "gone")], "gene string, target_id string")
    return merge.without_targets(allele_table(spark, sf_dir), out).select("file", "gene", "read_inner", "read_count")


_INCLUDED = f"CAST(coalesce(sum(read_count) FILTER (NOT {_EXCLUDED}), 0) AS BIGINT)"


@query(f"{_MERGED} SELECT gene, {_INCLUDED} AS total_reads, {_INCLUDED} AS matched_reads, {_INCLUDED} AS aligned_reads FROM merged GROUP BY gene")
def curated_totals(spark, sf_dir):
    n = F.col("read_count")
    per = _flagged(spark, sf_dir).groupBy("gene").agg(*(F.sum(n).alias(c) for c in ("total_reads", "matched_reads", "aligned_reads")), F.sum(F.when(F.col("excluded"), n).otherwise(0)).alias("excluded_reads"))
    return merge.curated_totals(per, F.col("excluded_reads")).drop("excluded_reads")


@query(
    """WITH r AS (SELECT s_suppkey AS ordinal, concat('g', CAST(s_suppkey % 7 AS VARCHAR)) AS name, concat('S', CAST(s_nationkey AS VARCHAR)) AS sequence FROM supplier),
    g AS (SELECT sequence, name, min(ordinal) AS seen FROM r GROUP BY ALL) SELECT sequence, min(seen) AS ordinal, string_agg(name, '/' ORDER BY seen) AS gene FROM g GROUP BY sequence"""
)
def merged_configs(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("ordinal"), F.concat(F.lit("g"), (k % 7).cast("string")).alias("gene"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("sequence"))
    return merge.merged_configs(rows)


@query("SELECT concat('g', CAST(s_nationkey AS VARCHAR)) AS gene, CASE WHEN s_nationkey % 2 = 0 THEN 'h' END AS homoeolog_group, concat('ACGT', CAST(s_nationkey AS VARCHAR)) AS sequence, CAST(s_suppkey AS VARCHAR) AS target_id, s_name AS guide FROM supplier")
def reference_export(spark, sf_dir):
    n = F.col("s_nationkey")
    target = F.struct(F.col("s_suppkey").cast("string").alias("target_id"), F.col("s_name").alias("guide"))
    genes = table(spark, sf_dir, "supplier").groupBy(n).agg(F.collect_list(target).alias("targets"))
    return references.gene_rows(genes.select(F.concat(F.lit("g"), n.cast("string")).alias("gene"), F.when(n % 2 == 0, "h").alias("homoeolog_group"), F.concat(F.lit("ACGT"), n.cast("string")).alias("sequence"), "targets"))


@query(
    f"""{ALLELES}, r AS (SELECT *, row_number() OVER (PARTITION BY file, gene ORDER BY read_count DESC, first_seen) AS nth FROM alleles)
    SELECT file, gene, CAST(sum(read_count) AS BIGINT) AS reads, CAST(count(*) AS INT) AS n_alleles, max(read_inner) FILTER (nth = 1) AS top, max(read_inner) FILTER (nth = 2) AS second FROM r GROUP BY file, gene"""
)
def nested_results(spark, sf_dir):
    scope = ("file", "gene")
    alleles = ranked(allele_table(spark, sf_dir).select(*scope, "read_inner", "read_count", "first_seen"), scope)
    totals = alleles.groupBy(*scope).agg(F.sum("read_count").alias("reads"))
    inner = lambda i: F.get("alleles", F.lit(i))["read_inner"]
    return export.nested(totals, alleles, scope).select(*scope, "reads", F.size("alleles").alias("n_alleles"), inner(0).alias("top"), inner(1).alias("second"))


@query(f"{READS} SELECT count(*) FILTER (q >= 20) AS aligned, count(*) AS total, {PCT.format('count(*) FILTER (q >= 20)', 'count(*)')} AS pct FROM reads")
def aligned_share(spark, sf_dir):
    return summary.first_usable(calls(spark, sf_dir))


@query(f"{READS}, t(gene_ix, target_ix, target_id) AS (VALUES (0, 0, 't1'), (0, 1, 't2'), (1, 0, 't1')) SELECT gene_ix, target_ix, target_id, count(*) AS reads FROM t JOIN reads ON (true_gene = 'A') = (gene_ix = 0) WHERE q >= 20 GROUP BY ALL")
def configured_targets(spark, sf_dir):
    """Every configured target with the reads of its gene."""
    r = reads(spark, sf_dir)
    counted = assigned(r, TWO_TARGETS).where("outcome = 'assigned'").groupBy("gene_ix").agg(F.count(F.lit(1)).alias("reads"))
    return summary.target_table(r, TWO_TARGETS).join(counted, "gene_ix").select("gene_ix", "target_ix", "target_id", "reads")


@query(
    """WITH f AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(p_partkey % 10 AS VARCHAR) AS b FROM part)
    SELECT p_partkey, concat('BC_', a, '-', b, '.FASTQ.gz') AS file, concat('BC_', a, '-', b) AS barcode, concat('bc', a, b) AS normalized FROM f"""
)
def barcode_names(spark, sf_dir):
    path = F.concat(F.lit("run.1/x/BC_"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 10).cast("string"), F.lit(".FASTQ.gz"))
    rows = table(spark, sf_dir, "part").select("p_partkey", names.file_name(path).alias("file"))
    code = names.barcode(F.col("file"))
    return rows.select("p_partkey", "file", code.alias("barcode"), names.normalized_barcode(code).alias("normalized"))


@query(
    """WITH v AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Barcode' ELSE substring(concat('lane ', k, ' a b abcdefghijklmnopqrstuvwxyz'), 1, 31) END AS sheet,
    CASE WHEN p_partkey % 5 = 0 THEN 'results' ELSE concat('lane[ ', k, ' ] a b abcdefghijklmnopqrstuvwxyz') END AS download FROM v"""
)
def sheet_names(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 5 == 0, " ?:* ").otherwise(F.concat(F.lit(" lane[ "), F.col("p_partkey").cast("string"), F.lit(" ] a/b  abcdefghijklmnopqrstuvwxyz.xlsx")))
    stem = F.regexp_replace(value, r"\.xlsx$", "")
    return table(spark, sf_dir, "part").select("p_partkey", names.sheet_name(stem).alias("sheet"), names.download_name(value, "results").alias("download"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('normal:name:', s_name) ELSE 'normal:sequence:ACGT' END AS gene_key,
    CASE WHEN s_suppkey % 2 = 0 THEN concat('t', CAST(s_suppkey AS VARCHAR)) ELSE 'CAT' END AS target_key FROM supplier"""
)
def result_keys(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.col("s_name").alias("gene"), F.lit("normal").alias("kind"), F.when(k % 3 == 0, " ").otherwise("ac gt").alias("sequence"), F.when(k % 2 != 0, "ca t").alias("guide"), F.concat(F.lit("t"), k.cast("string")).alias("target_id"))
    return merge.with_result_keys(rows).select("s_suppkey", "gene_key", "target_key")


@query(
    """WITH m AS (SELECT l_suppkey, 'lines' AS k, l_linenumber AS v FROM lineitem UNION ALL SELECT l_suppkey, concat('part', CAST(l_partkey % 3 AS VARCHAR)), l_orderkey % 10 FROM lineitem)
    SELECT l_suppkey, k, CAST(sum(v) AS BIGINT) AS v FROM m GROUP BY l_suppkey, k"""
)
def map_sums(spark, sf_dir):
    entries = F.create_map(F.lit("lines"), F.col("l_linenumber").cast("bigint"), F.concat(F.lit("part"), (F.col("l_partkey") % 3).cast("string")), (F.col("l_orderkey") % 10).cast("bigint"))
    return merge.numeric_maps_added(table(spark, sf_dir, "lineitem").select("l_suppkey", entries.alias("m")), "l_suppkey", "m")


@query("SELECT s_nationkey AS gene, count(DISTINCT s_suppkey % 3) AS sequences FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey % 3) > 1")
def conflicting_genes(spark, sf_dir):
    return references.conflicting_genes(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("gene"), (F.col("s_suppkey") % 3).alias("sequence")))


@query("SELECT CAST(max(p_size) AS BIGINT) AS window_left, CAST(max(100 + p_partkey % 50 - p_size) AS BIGINT) AS window_right FROM part")
def full_reference_window(spark, sf_dir):
    windows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50 + 100).alias("length"), F.col("p_size").alias("cut"), F.lit(True).alias("guide_found"))
    return references.full_reference_window(windows)
