"""Assignment, alleles, summaries, merging, curation and export, over reads made from orders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import AnalysisConfig

from ..operators import benchmark, export, merge, pairs, references, summary
from ..operators.alleles import SCOPE, alleles, called, kept, kept_and_ranked, target_hits
from ..operators.assign import assigned
from ..plans.analysis import hits_by_kind, run_analysis
from .fixtures import GENE_A90, READS, TRUTH, TWINS, TWO_GENES, TWO_TARGETS, WITH_GAPS, reads, table
from .registry import query

GENE = "CASE gene_ix WHEN 0 THEN 'A' ELSE 'B' END"
PCT = "floor({0} * 1.0e0 / {1} * 10000.0e0 + 0.5e0) / 100.0e0"
#: Alleles of the true genes, counted by file: the fact table of the SQL side.
ALLELES = TRUTH + """, alleles AS (SELECT file, true_gene AS gene, allele AS read_inner, count(*) AS read_count, min(read_index) AS first_seen,
  any_value(category) AS category, any_value(CAST(true_net AS INT)) AS net_indel FROM truth GROUP BY ALL)"""


def gene_name(c: str = "gene_ix"):
    return F.when(F.col(c) == 0, "A").otherwise("B")


def calls(spark, sf_dir, config: AnalysisConfig = TWO_GENES):
    return assigned(reads(spark, sf_dir), config)


def allele_table(spark, sf_dir):
    """file, gene, read_inner, read_count, first_seen, category, has_sub, net_indel, kind, target_id."""
    out = alleles(target_hits(calls(spark, sf_dir).where("outcome = 'assigned'")), TWO_GENES)
    return out.select("file", gene_name().alias("gene"), "kind", F.lit("t1").alias("target_id"), "read_inner", "read_count", "first_seen", "category", "has_sub", "net_indel")


@query(f"{READS} SELECT read_index, CASE WHEN q >= 20 THEN 'assigned' ELSE 'filtered' END AS outcome, CASE WHEN q >= 20 THEN true_gene END AS gene FROM reads")
def gene_assignment(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select("read_index", "outcome", F.when(F.col("gene_ix").isNotNull(), gene_name()).alias("gene"))


@query(f"{READS} SELECT read_index, CASE WHEN q >= 20 THEN 'assigned' ELSE 'filtered' END AS outcome, CASE WHEN q >= 20 THEN true_gene END AS gene FROM reads")
def target_assignment(spark, sf_dir):
    c = assigned(reads(spark, sf_dir), TWO_GENES, by_target=True)
    return c.select("read_index", "outcome", F.when(F.col("gene_ix").isNotNull(), gene_name()).alias("gene"))


_ONE = AnalysisConfig((GENE_A90,), phred=20.0)


@query(f"{READS} SELECT read_index, q >= 20 AS usable, CASE WHEN q < 20 THEN 'quality' ELSE 'ok' END AS reason, CASE WHEN q >= 20 AND true_gene = 'A' THEN substring(fwd, 20) END AS own_window, CASE WHEN q >= 20 THEN is_rc END AS is_rc FROM reads")
def read_usability(spark, sf_dir):
    """Every read against a window of gene A; the window itself is shown for A's reads, where SQL says what it is."""
    hits = target_hits(assigned(reads(spark, sf_dir), _ONE))
    return hits.select("read_index", (F.col("reason") == "ok").alias("usable"), "reason", F.when(F.col("true_gene") == "A", F.col("read_window")).alias("own_window"), "is_rc")


@query(f"{TRUTH} SELECT read_index, allele, category, false AS has_sub, CAST(true_net AS INT) AS net_indel FROM truth")
def mutation_calls(spark, sf_dir):
    hits = target_hits(calls(spark, sf_dir).where("outcome = 'assigned'")).where("reason = 'ok'")
    return called(hits, TWO_GENES).select("read_index", "allele", "category", "has_sub", "net_indel")


@query(f"{READS} SELECT file, count(*) AS total, count(*) FILTER (q >= 20) AS assigned, 0::BIGINT AS ambiguous, count(*) FILTER (q < 20) AS filtered, count(*) FILTER (q >= 20) AS usable FROM reads GROUP BY file")
def demux_counts(spark, sf_dir):
    return summary.demux_counts(calls(spark, sf_dir)).drop("avg_best_score")


@query(f"{READS}, g AS (SELECT unnest(['A', 'B']) AS gene), f AS (SELECT DISTINCT file FROM reads) SELECT file, gene, (SELECT count(*) FROM reads r WHERE r.file = f.file AND true_gene = gene AND q >= 20) AS assigned FROM f, g")
def gene_counts(spark, sf_dir):
    return summary.gene_counts(calls(spark, sf_dir), TWO_GENES)


@query(f"{READS} SELECT file, 'quality' AS reason, count(*) AS n FROM reads WHERE q < 20 GROUP BY file")
def failure_reasons(spark, sf_dir):
    return summary.failure_counts(target_hits(assigned(reads(spark, sf_dir), _ONE))).select("file", "reason", "n")


@query(f"{ALLELES} SELECT file, gene, read_inner, read_count, first_seen, category, false AS has_sub, net_indel FROM alleles")
def alleles_by_target(spark, sf_dir):
    return allele_table(spark, sf_dir).drop("kind", "target_id")


_KEPT = ALLELES + """, run AS (SELECT *, sum(read_count) OVER (PARTITION BY file, gene ORDER BY read_count DESC, first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM alleles),
 good AS (SELECT * FROM run WHERE (read_count * 1.0e0 / running) * 100.0e0 >= 1.0e0)"""


@query(f"{_KEPT} SELECT file, gene, read_inner, read_count FROM good")
def allele_threshold(spark, sf_dir):
    return kept(allele_table(spark, sf_dir), ("file", "gene"), 1.0).select("file", "gene", "read_inner", "read_count")


@query(f"{_KEPT} SELECT file, gene, read_inner, row_number() OVER (PARTITION BY file, gene ORDER BY read_count DESC, first_seen) AS group_rank FROM good")
def rank_alleles(spark, sf_dir):
    return kept_and_ranked(allele_table(spark, sf_dir), ("file", "gene"), 1.0).select("file", "gene", "read_inner", F.col("group_rank").cast("bigint").alias("group_rank"))


@query(
    f"""{_KEPT}, m AS (SELECT file, true_gene AS gene, count(*) AS total_reads, count(*) FILTER (NOT is_rc) AS forward_reads, count(*) FILTER (is_rc) AS reverse_reads FROM truth GROUP BY ALL),
    k AS (SELECT file, gene, CAST(sum(read_count) AS BIGINT) AS aligned_reads, CAST(coalesce(sum(read_count) FILTER (category = 'out_of_frame'), 0) AS BIGINT) AS out_of_frame,
      CAST(coalesce(sum(read_count) FILTER (category = 'in_frame'), 0) AS BIGINT) AS in_frame, CAST(coalesce(sum(read_count) FILTER (category = 'no_indel'), 0) AS BIGINT) AS unmodified FROM good GROUP BY ALL)
    SELECT file, gene, total_reads, total_reads AS matched_reads, forward_reads, reverse_reads, aligned_reads, out_of_frame, in_frame, 0::BIGINT AS substitution, unmodified, out_of_frame + in_frame AS modified,
      {PCT.format('(out_of_frame + in_frame)', 'aligned_reads')} AS modified_pct, {PCT.format('out_of_frame', 'aligned_reads')} AS out_of_frame_pct, {PCT.format('in_frame', 'aligned_reads')} AS in_frame_pct,
      {PCT.format('unmodified', 'aligned_reads')} AS unmodified_pct FROM m JOIN k USING (file, gene)"""
)
def target_summary(spark, sf_dir):
    r = run_analysis(reads(spark, sf_dir), TWO_GENES).summary
    drop = [c for c in r.columns if c.startswith("fail_")]
    return r.withColumn("gene", gene_name()).drop("gene_ix", "target_ix", "kind", "substitution_pct", "error", *drop)


@query(
    f"""{_KEPT}, m AS (SELECT file, true_gene AS gene, count(*) AS total_reads, count(*) FILTER (NOT is_rc) AS forward_reads, count(*) FILTER (is_rc) AS reverse_reads FROM truth GROUP BY ALL),
    k AS (SELECT file, gene, CAST(sum(read_count) AS BIGINT) AS aligned_reads, CAST(coalesce(sum(read_count) FILTER (category <> 'no_indel'), 0) AS BIGINT) AS modified FROM good GROUP BY ALL),
    f AS (SELECT DISTINCT file FROM reads), t(gene, target_id, error) AS (VALUES ('A', 't1', NULL), ('A', 'gone', 'gRNA not found in reference'), ('B', 't1', NULL), ('C', 't1', NULL))
    SELECT f.file, t.gene, t.target_id, t.error, coalesce(total_reads, 0) AS total_reads, CASE WHEN error IS NULL THEN coalesce(total_reads, 0) ELSE 0 END AS matched_reads,
      CASE WHEN error IS NULL THEN coalesce(forward_reads, 0) ELSE 0 END AS forward_reads, CASE WHEN error IS NULL THEN coalesce(reverse_reads, 0) ELSE 0 END AS reverse_reads,
      CASE WHEN error IS NULL THEN coalesce(aligned_reads, 0) ELSE 0 END AS aligned_reads, CASE WHEN error IS NULL THEN coalesce(modified, 0) ELSE 0 END AS modified
    FROM f CROSS JOIN t LEFT JOIN m ON m.file = f.file AND m.gene = t.gene LEFT JOIN k ON k.file = f.file AND k.gene = t.gene"""
)
def target_breakdown(spark, sf_dir):
    """Every configured target has a row: one without its guide an error, one without reads zeros."""
    r = run_analysis(reads(spark, sf_dir), WITH_GAPS).summary
    name = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("gene_ix") + 1)
    target = F.when((F.col("gene_ix") == 0) & (F.col("target_ix") == 1), "gone").otherwise("t1").alias("target_id")
    return r.select("file", name("ABC").alias("gene"), target, "error", "total_reads", "matched_reads", "forward_reads", "reverse_reads", "aligned_reads", "modified")


def _edits(spark, sf_dir):
    return summary.edited_targets(target_hits(calls(spark, sf_dir, TWO_TARGETS).where("outcome = 'assigned'")), TWO_TARGETS)


@query(f"{TRUTH} SELECT file, count(*) AS evaluated_reads, count(*) FILTER (true_net = 0) AS none, 0::BIGINT AS one, count(*) FILTER (true_net <> 0) AS two, 0::BIGINT AS three_or_more FROM truth WHERE true_gene = 'A' GROUP BY file")
def multi_target_summary(spark, sf_dir):
    return summary.multi_target(_edits(spark, sf_dir)).drop("gene_ix", "kind")


@query(f"{TRUTH} SELECT file, 't1' AS target_a, 't2' AS target_b, count(*) AS n FROM truth WHERE true_gene = 'A' AND true_net <> 0 GROUP BY file")
def co_edit_matrix(spark, sf_dir):
    t = lambda c: F.concat(F.lit("t"), (F.col(c) + 1).cast("string")).alias(c)
    return summary.co_edits(_edits(spark, sf_dir)).select("file", t("target_a"), t("target_b"), "n")


@query(
    f"""{READS}, g AS (SELECT true_gene AS gene, q FROM reads UNION ALL SELECT 'All', q FROM reads) SELECT gene, count(*) AS total, count(*) FILTER (q >= 20) AS usable, count(*) FILTER (q < 20) AS filtered,
    count(*) FILTER (q >= 20) AS correct, 0::BIGINT AS wrong, 0::BIGINT AS ambiguous, 100.0e0 AS correct_rate, 0.0e0 AS wrong_rate, 0.0e0 AS ambiguous_rate FROM g GROUP BY gene"""
)
def benchmark_confusion(spark, sf_dir):
    return benchmark.confusion(calls(spark, sf_dir).withColumn("predicted", gene_name()))


_ACCURACY = replace(TWO_TARGETS, genes=(*TWO_TARGETS.genes, WITH_GAPS.genes[2]))


@query(
    f"""{READS}, t AS (SELECT true_gene AS gene, CASE WHEN true_gene = 'A' AND read_index % 2 = 0 THEN 't2' ELSE 't1' END AS target, 1 AS n, q FROM reads UNION ALL VALUES ('C', 't1', 0, 35)),
    g AS (SELECT gene, target, n, q FROM t UNION ALL SELECT 'All', 'All', n, q FROM t),
    c AS (SELECT gene, target, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (q >= 20), 0) AS BIGINT) AS correct, CAST(coalesce(sum(n) FILTER (q < 20), 0) AS BIGINT) AS filtered FROM g GROUP BY ALL),
    r AS (SELECT *, CASE WHEN total = 0 THEN 0.0e0 ELSE floor(correct * 1.0e0 / total * 1000.0e0 + 0.5e0) / 10.0e0 END AS share FROM c)
    SELECT gene, target, total, correct AS usable, correct, 0::BIGINT AS wrong, 0::BIGINT AS ambiguous, filtered, share AS usable_rate, CASE WHEN correct = 0 THEN 0.0e0 ELSE 100.0e0 END AS correct_rate, 0.0e0 AS wrong_rate, 0.0e0 AS ambiguous_rate,
      share AS correct_rate_total, 0.0e0 AS wrong_rate_total, 0.0e0 AS ambiguous_rate_total, 0::BIGINT AS fail_no_anchor, filtered AS fail_quality, 0::BIGINT AS fail_similarity, 0::BIGINT AS fail_no_coverage, 0::BIGINT AS fail_no_alignment FROM r"""
)
def benchmark_by_target(spark, sf_dir):
    true_target = F.when((F.col("true_gene") == "A") & (F.col("read_index") % 2 == 0), "t2").otherwise("t1")
    return benchmark.accuracy(calls(spark, sf_dir, _ACCURACY).withColumn("true_target", true_target), _ACCURACY)


_PAIRED = replace(TWO_GENES, paired_window=90)


def _mates(spark, sf_dir, size: int = 70):
    """Both mates of each molecule: its first bases, and the reverse complement of its last ones."""
    r = reads(spark, sf_dir).withColumn("pair_id", F.col("file"))
    one = r.select("pair_id", "read_index", F.concat("read_id", F.lit("/1")).alias("read_id"), F.substring("fwd", 1, size).alias("seq"), F.substring("qual", 1, size).alias("qual"))
    two = r.select("pair_id", "read_index", F.concat("read_id", F.lit("/2")).alias("read_id"), F.expr(f"reverse(translate(right(fwd, {size}), 'ACGT', 'TGCA'))").alias("seq"), F.substring("qual", 1, size).alias("qual"))
    return one, two


@query(f"{READS} SELECT read_index, fwd AS seq, length(fwd) AS size, true AS merged, CAST(140 - length(fwd) AS INT) AS overlap FROM reads")
def pair_overlap_merge(spark, sf_dir):
    m = pairs.merged(pairs.mate_records(*_mates(spark, sf_dir)), _PAIRED)
    return m.select("read_index", "seq", F.length("qual").cast("bigint").alias("size"), "merged", "overlap")


@query(f"{READS} SELECT read_index, concat(substring(fwd, 1, 40), repeat('X', 90), right(fwd, 40)) AS seq, false AS merged FROM reads")
def pair_gap_padding(spark, sf_dir):
    return pairs.merged(pairs.mate_records(*_mates(spark, sf_dir, 40)), _PAIRED).select("read_index", "seq", "merged")


@query(
    f"""{READS} SELECT count(*) AS input_molecules, count(*) FILTER (q >= 20) AS phred_passed, count(*) FILTER (q >= 20) AS normalized, count(*) FILTER (q >= 20) AS consensus, 0::BIGINT AS padded, count(*) FILTER (q < 20) AS filtered,
    count(*) FILTER (q < 20) AS fail_quality, 0::BIGINT AS fail_no_anchor, 0::BIGINT AS fail_no_coverage, 0::BIGINT AS fail_no_alignment, 0::BIGINT AS fail_no_target_window FROM reads"""
)
def preprocess_stats(spark, sf_dir):
    return pairs.preprocess_stats(pairs.judged(pairs.merged(pairs.mate_records(*_mates(spark, sf_dir)), _PAIRED), _PAIRED), _PAIRED)


@query(f"{READS} SELECT count(*) AS pairs, count(*) AS consensus, 0::BIGINT AS padded, avg(length(fwd)) AS mean_length FROM reads")
def merge_stats(spark, sf_dir):
    return pairs.merge_stats(pairs.merged(pairs.mate_records(*_mates(spark, sf_dir)), _PAIRED))


_FILES = """WITH f AS (SELECT p_partkey AS ordinal, p_partkey // 2 AS k, concat('s', CAST(p_partkey // 2 AS VARCHAR), CASE p_partkey % 2 WHEN 0 THEN '_R1.fastq' ELSE '_R2.fastq' END) AS name FROM part)"""


@query(f"{_FILES} SELECT min(ordinal) AS pair, max(name) FILTER (ordinal % 2 = 0) AS r1, max(name) FILTER (ordinal % 2 = 1) AS r2, concat('S ', CAST(k AS VARCHAR)) AS pair_name FROM f GROUP BY k")
def mate_file_pairs(spark, sf_dir):
    k = F.floor(F.col("p_partkey") / 2).cast("string")
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("s"), k, F.when(F.col("p_partkey") % 2 == 0, "_R1.fastq").otherwise("_R2.fastq")).alias("name"))
    return pairs.file_pairs(files)


@query(
    """WITH e AS (SELECT l_orderkey, concat('g', CAST(l_suppkey % 3 AS VARCHAR)) AS gene, l_partkey AS target, min(l_discount) AS score FROM lineitem GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, gene ORDER BY score DESC, target) AS nth, lead(score) OVER (PARTITION BY l_orderkey, gene ORDER BY score DESC, target) AS second FROM e),
    a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, target) AS place, lead(score) OVER (PARTITION BY l_orderkey ORDER BY score DESC, target) AS rival FROM b WHERE nth = 1)
    SELECT l_orderkey AS read_index, gene, CAST(target AS VARCHAR) AS target_id, score FROM a WHERE place = 1 AND (rival IS NULL OR score - rival >= 0.02e0) AND (second IS NULL OR score - second >= 0.02e0)"""
)
def consensus_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_index"), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("gene"), F.col("l_partkey").alias("ordinal")).agg(F.min("l_discount").alias("r1_score"))
    return pairs.consensus_evidence(e.withColumn("r2_score", F.col("r1_score")).withColumn("target_id", F.col("ordinal").cast("string")), 0.02)


_MERGED = ALLELES + """, merged AS (SELECT gene, read_inner, CAST(sum(read_count) AS BIGINT) AS read_count, min(first_seen) AS first_seen, any_value(category) AS category, any_value(net_indel) AS net_indel FROM alleles GROUP BY ALL)"""


@query(f"{_MERGED} SELECT gene, read_inner, read_count, row_number() OVER (PARTITION BY gene ORDER BY read_count DESC, first_seen) AS group_rank FROM merged")
def file_merge(spark, sf_dir):
    out = merge.merged_alleles(allele_table(spark, sf_dir), ("gene",))
    return out.select("gene", "read_inner", "read_count", F.col("group_rank").cast("bigint").alias("group_rank"))


@query(f"{ALLELES}, s AS (SELECT file AS scope, gene, read_count FROM alleles UNION ALL SELECT 'Merged', gene, read_count FROM alleles) SELECT scope, gene, CAST(sum(read_count) AS BIGINT) AS read_count FROM s GROUP BY ALL")
def merged_rollup(spark, sf_dir):
    return merge.rollup_files(allele_table(spark, sf_dir), ("gene",), ("read_count",))


@query(f"{READS}, s AS (SELECT file AS scope, q FROM reads UNION ALL SELECT 'Merged', q FROM reads) SELECT scope, count(*) AS total, count(*) FILTER (q >= 20) AS usable, count(*) FILTER (q >= 20) AS assigned, 0::BIGINT AS ambiguous FROM s GROUP BY scope")
def read_flow(spark, sf_dir):
    return merge.read_flow(summary.demux_counts(calls(spark, sf_dir)))


_EXCLUDED = "read_count % 3 = 0"


@query(f"{ALLELES} SELECT file, gene, read_inner, read_count FROM alleles WHERE file <> 'f1'")
def curate_files(spark, sf_dir):
    out = spark.range(1).select(F.lit("f1").alias("file"))
    return merge.without_files(allele_table(spark, sf_dir), out).select("file", "gene", "read_inner", "read_count")


def _flagged(spark, sf_dir):
    rows = merge.merged_alleles(allele_table(spark, sf_dir), ("gene", "target_id"))
    return merge.with_excluded(rows, rows.where(_EXCLUDED).select("gene", "target_id", "read_inner"))


@query(f"{_MERGED} SELECT gene, read_inner, {_EXCLUDED} AS excluded, row_number() OVER (PARTITION BY gene ORDER BY {_EXCLUDED}, read_count DESC, first_seen) AS group_rank FROM merged")
def curate_groups(spark, sf_dir):
    out = merge.curated_ranks(_flagged(spark, sf_dir), ("gene", "target_id"))
    return out.select("gene", "read_inner", "excluded", F.col("group_rank").cast("bigint").alias("group_rank"))


@query(
    f"""{_MERGED}, c AS (SELECT gene, CAST(coalesce(sum(read_count) FILTER (NOT {_EXCLUDED}), 0) AS BIGINT) AS aligned_reads, CAST(coalesce(sum(read_count) FILTER ({_EXCLUDED}), 0) AS BIGINT) AS excluded_reads,
    CAST(coalesce(sum(read_count) FILTER (NOT {_EXCLUDED} AND category <> 'no_indel'), 0) AS BIGINT) AS modified FROM merged GROUP BY gene)
    SELECT *, CASE WHEN aligned_reads > 0 THEN {PCT.format('modified', 'aligned_reads')} ELSE 0.0e0 END AS modified_pct FROM c"""
)
def curated_summary(spark, sf_dir):
    return merge.curated_summary(_flagged(spark, sf_dir), ("gene", "target_id")).select("gene", "aligned_reads", "excluded_reads", "modified", "modified_pct")


@query(f"{TRUTH}, top AS (SELECT true_gene, allele FROM truth GROUP BY ALL ORDER BY count(*) DESC, min(read_index) LIMIT 5) SELECT read_index, seq, qual FROM truth SEMI JOIN top USING (true_gene, allele)")
def export_semi_join(spark, sf_dir):
    hits = target_hits(calls(spark, sf_dir).where("outcome = 'assigned'")).where("reason = 'ok'")
    rows = hits.select("read_index", "gene_ix", "seq", "qual", F.col("read_window").alias("allele"))
    top = rows.groupBy("gene_ix", "allele").agg(F.count(F.lit(1)).alias("n"), F.min("read_index").alias("first")).orderBy(F.desc("n"), "first").limit(5)
    return export.reads_of_alleles(rows, ("gene_ix", "allele"), top).select("read_index", "seq", "qual")


@query(f"{ALLELES} SELECT file, gene, read_inner, read_count FROM alleles")
def json_roundtrip(spark, sf_dir):
    packed = allele_table(spark, sf_dir).select("file", "gene", F.struct("read_inner", "read_count").alias("v"))
    return export.json_round_trip(packed, "v").select("file", "gene", "v.*")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def chunked_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return export.from_chunks(export.to_chunks(docs, "doc_id", "text"), "doc_id").select("doc_id", F.col("value").alias("text"))


_CLUSTERS = TRUTH + ", c AS (SELECT file, fwd AS key, count(*) AS n FROM truth GROUP BY ALL)"


@query(f"{_CLUSTERS} SELECT file, key, n AS cluster, n >= 20 AS rescued FROM c")
def rescue_clusters(spark, sf_dir):
    """Reads that two equal references tie for, by what they observe."""
    c = assigned(reads(spark, sf_dir), TWINS)
    return summary.rescued(c, TWINS).select("file", "key", "cluster", "rescued").distinct()


@query(f"{_CLUSTERS}, k AS (SELECT CASE WHEN n >= 20 THEN 'rescued' ELSE 'ambiguous' END AS kind, n FROM c), g AS (SELECT 'A' AS gene, * FROM k UNION ALL SELECT 'A2', * FROM k WHERE kind = 'ambiguous') SELECT gene, kind, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL")
def ambiguous_union(spark, sf_dir):
    hits = hits_by_kind(assigned(reads(spark, sf_dir), TWINS), TWINS).where("reason = 'ok'")
    return hits.groupBy(F.when(F.col("gene_ix") == 0, "A").otherwise("A2").alias("gene"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{READS} SELECT read_index, concat('@', read_id, chr(10), seq, chr(10), '+', chr(10), qual) AS record FROM reads")
def fastq_serialize(spark, sf_dir):
    r = reads(spark, sf_dir)
    return r.select("read_index", export.fastq_record(F.col("read_id"), F.col("seq"), F.col("qual"), F.col("read_index")).alias("record"))


@query(f"{READS} SELECT count(*) AS reads, sum(length(seq)) * 1.0e0 / count(*) AS avg_length, CAST(min(length(seq)) AS INT) AS min_length, CAST(max(length(seq)) AS INT) AS max_length, round(avg(length(regexp_replace(seq, '[^GC]', '', 'g')) * 1.0e0 / length(seq) * 100), 6) AS avg_gc, sum(q * length(seq)) * 1.0e0 / sum(length(seq)) AS avg_quality FROM reads")
def fastq_stats(spark, sf_dir):
    return benchmark.fastq_stats(reads(spark, sf_dir)).withColumn("avg_gc", F.round("avg_gc", 6))


@query(f"{READS} SELECT CAST(length(seq) // 10 * 10 AS BIGINT) AS bucket, count(*) AS n FROM reads GROUP BY 1")
def length_histogram(spark, sf_dir):
    return benchmark.length_histogram(reads(spark, sf_dir))


@query(f"{READS} SELECT CAST(q // 2 * 2 AS BIGINT) AS bucket, CAST(sum(length(qual)) AS BIGINT) AS n FROM reads GROUP BY 1")
def quality_histogram(spark, sf_dir):
    return benchmark.quality_histogram(reads(spark, sf_dir))


_IMPORT = """WITH r AS (SELECT s_suppkey AS ordinal, s_name AS gene, concat('acgt ', CAST(s_nationkey AS VARCHAR)) AS sequence, concat('g', CAST(s_suppkey % 4 AS VARCHAR)) AS guide FROM supplier),
 c AS (SELECT ordinal, gene, upper(regexp_replace(sequence, '\\s+', '', 'g')) AS sequence, upper(guide) AS guide FROM r)"""


@query(
    f"""{_IMPORT}, g AS (SELECT sequence, min(ordinal) AS first, string_agg(gene, '/' ORDER BY ordinal) AS display FROM c GROUP BY sequence), n AS (SELECT *, row_number() OVER (ORDER BY first) AS reference_ix FROM g),
    t AS (SELECT sequence, guide, min(ordinal) AS first_at FROM c GROUP BY ALL)
    SELECT CAST(reference_ix AS INT) AS reference_ix, concat('reference-', CAST(reference_ix AS VARCHAR)) AS gene, display, sequence, CAST(row_number() OVER (PARTITION BY sequence ORDER BY first_at) AS INT) AS target_ix, guide FROM n JOIN t USING (sequence)"""
)
def reference_payload(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("Ordinal"), F.col("s_name").alias("Gene Name"), F.concat(F.lit("acgt "), F.col("s_nationkey").cast("string")).alias("Sequence"), F.concat(F.lit("g"), (F.col("s_suppkey") % 4).cast("string")).alias("sgRNA"))
    return references.reference_payload(references.reference_rows(rows)).drop("target_id")


@query("SELECT o_orderkey AS id, concat('n', CAST(o_custkey AS VARCHAR)) AS name, CASE WHEN o_orderkey % 10 = 0 THEN 'by-id' WHEN o_custkey % 10 = 0 THEN 'by-name' ELSE 'default' END AS config_key FROM orders")
def config_override(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    inputs = o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name"))
    ids = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("input"), F.lit("by-id").alias("config_key"))
    by_name = o.where("o_custkey % 10 = 0").select(F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("input"), F.lit("by-name").alias("config_key")).distinct()
    return references.with_config(inputs, ids.union(by_name)).withColumn("id", F.col("id").cast("bigint"))


@query(f"{READS} SELECT 'CATGRWTT' AS query, read_index, read_id, seq FROM reads WHERE regexp_matches(seq, 'CATG[AG][AT]TT') UNION ALL SELECT '77', read_index, read_id, seq FROM reads WHERE contains(read_id, '77')")
def viewer_filter(spark, sf_dir):
    """A search by motif and one by name."""
    r = reads(spark, sf_dir).withColumn("category", F.lit(""))
    found = lambda text: benchmark.viewer_filter(r, text).select(F.lit(text).alias("query"), "read_index", "read_id", "seq")
    return found("CATGRWTT").union(found("77"))


@query(f"{READS} SELECT read_index, q >= 20 AS aligned FROM reads ORDER BY q >= 20 DESC, read_index LIMIT 10 OFFSET 20")
def viewer_page(spark, sf_dir):
    r = calls(spark, sf_dir).withColumn("aligned", F.col("outcome") == "assigned")
    return benchmark.viewer_page(r, 2).select("read_index", "aligned")


