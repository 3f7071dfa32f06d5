"""Sequence documents, features and homoeolog statistics, over DNA made from documents and over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import AMBIGUITY, AMINO_ACIDS
from ..operators import columns, export, genomes, homoeolog, workspace
from ..sources.shared import new_path
from ..streaming import history
from ..streaming.versions import Versions
from .fixtures import DNA, GUIDE_A, GUIDE_B, REF_A, REF_B, dna, table
from .registry import query


def _sites_sql() -> str:
    parts = []
    for e in workspace.ENZYMES:
        rc = e.site[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for strand, motif in ((1, e.site), (-1, rc)):
            if strand < 0 and rc == e.site:
                continue
            top, bottom = (e.top, e.bottom) if strand > 0 else (e.bottom, e.top)
            parts.append(f"('{e.name}', '{motif}', {top}, {bottom}, {strand}, {str(e.type_iis).lower()})")
    n = max(len(e.site) for e in workspace.ENZYMES) - 1
    return f"""{DNA}, e(enzyme, motif, top, bottom, strand, type_iis) AS (VALUES {', '.join(parts)}), c AS (SELECT doc_id, length(seq) AS n, concat(seq, substring(seq, 1, {n})) AS s FROM dna),
    h AS (SELECT doc_id, n, e.*, unnest(list_filter(range(0, n), lambda p: substring(s, CAST(p AS INT) + 1, length(motif)) = motif)) AS pos FROM c, e WHERE contains(s, motif))
    SELECT doc_id, enzyme, CAST(pos AS INT) AS start, CAST((pos + length(motif)) % n AS INT) AS "end", CAST((pos + top) % n AS INT) AS cut_top, CAST((pos + bottom) % n AS INT) AS cut_bottom, CAST(strand AS INT) AS strand, type_iis FROM h"""


@query(_sites_sql())
def restriction_sites(spark, sf_dir):
    return workspace.restriction_sites(dna(spark, sf_dir), circular=True)


_MOTIF = "GANTCRRW"


def _motif_sql() -> str:
    rc = workspace._reverse(_MOTIF)
    regex = lambda m: "".join(AMBIGUITY[c] for c in m)
    return f"""{DNA}, m(strand, re) AS (VALUES (1, '^{regex(_MOTIF)}$'), (-1, '^{regex(rc)}$')),
    h AS (SELECT doc_id, seq, strand, unnest(list_filter(range(0, length(seq) - {len(_MOTIF) - 1}), lambda p: regexp_matches(substring(seq, CAST(p AS INT) + 1, {len(_MOTIF)}), re))) AS pos FROM dna, m)
    SELECT doc_id, CAST(pos AS INT) AS start, CAST(pos + {len(_MOTIF)} AS INT) AS "end", CAST(strand AS INT) AS strand, substring(seq, CAST(pos AS INT) + 1, {len(_MOTIF)}) AS "match" FROM h"""


@query(_motif_sql())
def motif_search(spark, sf_dir):
    return workspace.motif_search(dna(spark, sf_dir), _MOTIF)


_ORFS = DNA + f""", c AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 2)) AS i FROM dna),
 m AS (SELECT doc_id, i, length(seq) AS n, substring(seq, CAST(i AS INT) + 1, 3) AS codon, seq FROM c),
 k AS (SELECT doc_id, seq, n, 1 AS strand, i AS pos, codon = 'ATG' AS opens FROM m WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA') UNION ALL SELECT doc_id, seq, n, -1, n - 3 - i AS pos, codon = 'CAT' FROM m WHERE codon IN ('CAT', 'TTA', 'CTA', 'TCA')),
 g AS (SELECT *, coalesce(sum(CASE WHEN opens THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, strand, pos % 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k),
 o AS (SELECT doc_id, any_value(seq) AS seq, any_value(n) AS n, strand, pos % 3 AS frame, min(pos) FILTER (opens) AS a, max(pos) FILTER (NOT opens) + 3 AS b FROM g GROUP BY doc_id, strand, pos % 3, part),
 t AS (SELECT *, substring(CASE WHEN strand > 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS dna FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND b - a >= 90)
 SELECT doc_id, CAST(CASE WHEN strand > 0 THEN a ELSE n - b END AS INT) AS start, CAST(CASE WHEN strand > 0 THEN b ELSE n - a END AS INT) AS "end", CAST(strand * (frame + 1) AS INT) AS frame, CAST(strand AS INT) AS strand,
   array_to_string(list_transform(range(0, length(dna) // 3), lambda j: substring('{AMINO_ACIDS}', CAST(16 * (strpos('TCAG', dna[3 * j + 1]) - 1) + 4 * (strpos('TCAG', dna[3 * j + 2]) - 1) + strpos('TCAG', dna[3 * j + 3]) AS INT), 1)), '') AS protein FROM t"""


@query(_ORFS)
def find_orfs(spark, sf_dir):
    return workspace.find_orfs(dna(spark, sf_dir))


@query(_ORFS)
def find_orfs_in_chunks(spark, sf_dir):
    """The same over sequences cut into chunks, frames carried from one to the next."""
    return genomes.chunked_orfs(dna(spark, sf_dir), size=1000)


@query(_sites_sql())
def restriction_sites_in_chunks(spark, sf_dir):
    return genomes.chunked_sites(dna(spark, sf_dir), circular=True, size=5000)


@query(_motif_sql())
def motif_search_in_chunks(spark, sf_dir):
    return genomes.chunked_motifs(dna(spark, sf_dir), _MOTIF, size=5000)


@query(f"{DNA} SELECT doc_id, concat('>d', CAST(doc_id AS VARCHAR), chr(10), rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)), chr(10)) AS record FROM dna")
def fasta_wrap80(spark, sf_dir):
    d = dna(spark, sf_dir)
    return d.select("doc_id", export.fasta_record(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("seq")).alias("record"))


_STRIPS = DNA + """, r AS (SELECT doc_id, seq, unnest(range(0, length(seq), 60)) AS pos FROM dna WHERE length(seq) > 0)
 SELECT doc_id, CAST(pos // 60 AS INT) AS row, CAST(pos AS INT) AS start, CAST(least(pos + 60, length(seq)) AS INT) AS "end", substring(seq, CAST(pos AS INT) + 1, 60) AS bases, translate(substring(seq, CAST(pos AS INT) + 1, 60), 'ACGT', 'TGCA') AS complement FROM r"""


@query(_STRIPS)
def row_strips(spark, sf_dir):
    return workspace.row_strips(dna(spark, sf_dir))


_FEATURES = "SELECT p_partkey AS feature_id, p_partkey % 50 AS doc_id, p_partkey % 400 AS start, p_partkey % 400 + p_size * 3 AS \"end\" FROM part"


def features(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("feature_id"), (F.col("p_partkey") % 50).alias("doc_id"), (F.col("p_partkey") % 400).alias("start"), (F.col("p_partkey") % 400 + F.col("p_size") * 3).alias("end"))


@query(
    f"""WITH f AS ({_FEATURES}), s AS (SELECT feature_id, doc_id, CASE WHEN start >= 130 THEN start - 20 WHEN start >= 100 THEN 100 ELSE start END AS start,
    CASE WHEN "end" > 130 THEN "end" - 20 WHEN "end" > 100 THEN 100 ELSE "end" END AS "end" FROM f) SELECT * FROM s WHERE start < "end" """
)
def shift_features(spark, sf_dir):
    return workspace.shifted_features(features(spark, sf_dir), F.lit(100), F.lit(30), F.lit(10))


@query(
    f"""WITH f AS ({_FEATURES}), r AS (SELECT unnest(range(0, 12)) AS row) SELECT doc_id, feature_id, row, greatest(start, row * 60) AS clip_start, least("end", (row + 1) * 60) AS clip_end
    FROM f JOIN r ON f.start < (row + 1) * 60 AND f."end" > row * 60"""
)
def feature_overlap(spark, sf_dir):
    return workspace.features_in_rows(features(spark, sf_dir), 60)


@query(
    f"""WITH RECURSIVE f AS ({_FEATURES}), g AS (SELECT unnest(range(0, 12)) AS row), c AS (SELECT doc_id, feature_id, row, greatest(start, row * 60) AS clip_start, least("end", (row + 1) * 60) AS clip_end
    FROM f JOIN g ON f.start < (row + 1) * 60 AND f."end" > row * 60), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row ORDER BY clip_start, feature_id) AS nth FROM c),
    r AS (SELECT doc_id, feature_id, row, clip_start, clip_end, nth, 0::BIGINT AS level, [clip_end] AS free FROM o WHERE nth = 1 UNION ALL
      SELECT doc_id, feature_id, row, clip_start, clip_end, nth, coalesce(line, len(free) + 1) - 1, CASE WHEN line IS NULL THEN list_append(free, clip_end) ELSE list_transform(free, lambda e, i: CASE WHEN i = line THEN clip_end ELSE e END) END
      FROM (SELECT o.*, r.free, nullif(list_position(list_transform(r.free, lambda e: e <= o.clip_start), true), 0) AS line FROM r JOIN o ON r.doc_id = o.doc_id AND r.row = o.row AND o.nth = r.nth + 1))
    SELECT doc_id, feature_id, row, clip_start, clip_end, CAST(level AS INT) AS level FROM r"""
)
def feature_levels(spark, sf_dir):
    return workspace.stacked(workspace.features_in_rows(features(spark, sf_dir), 60))


@query(f"WITH f AS ({_FEATURES}) SELECT feature_id, doc_id, start, CASE WHEN feature_id % 7 = 0 THEN start + 1 ELSE \"end\" END AS \"end\" FROM f WHERE feature_id % 11 <> 0")
def feature_upsert(spark, sf_dir):
    f = features(spark, sf_dir)
    changed = workspace.upserted(f, f.where("feature_id % 7 = 0").withColumn("end", F.col("start") + 1))
    return workspace.without(changed, f.where("feature_id % 11 = 0"))


@query(f"{DNA} SELECT doc_id, concat(substring(seq, 1, 10), 'GATTACA', substring(seq, 11)) AS inserted, concat(substring(seq, 1, 10), substring(seq, 16)) AS deleted FROM dna")
def sequence_edits(spark, sf_dir):
    seq = F.col("seq")
    return dna(spark, sf_dir).select("doc_id", workspace.inserted(seq, F.lit(10), F.lit("GATTACA")).alias("inserted"), workspace.deleted(seq, F.lit(10), F.lit(5)).alias("deleted"))


@query("SELECT o_custkey AS id, max(o_orderkey) AS saved_at FROM orders GROUP BY o_custkey")
def latest_version(spark, sf_dir):
    return workspace.latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("saved_at")))


_EDITS = """WITH o AS (SELECT o_custkey AS id, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 d AS (SELECT *, least(id % 4, n - 1, 20) AS undone, CASE WHEN id % 4 > 1 THEN least(id % 4, n - 1, 20) > 0 ELSE false END AS again FROM o),
 e AS (SELECT *, undone - CASE WHEN again THEN 1 ELSE 0 END AS back FROM d)
 SELECT id, version, CASE WHEN id % 5 = 0 THEN concat('n', CAST(id AS VARCHAR)) END AS name, CAST(least(n - 1, 20) - back AS INT) AS undo_steps, CAST(back AS INT) AS redo_steps FROM e WHERE i = n - back AND id % 7 <> 0"""


def edits(spark, sf_dir):
    """Each customer's orders are saved in turn; then (a second table) some are undone, one of these done again, some items renamed, and some deleted."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"))
    none, id_ = F.lit(None).cast("bigint"), F.col("id")

    def later(k, action, when):
        name = F.concat(F.lit(" n"), id_.cast("string")) if action == "rename" else F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit((1 << 60) + k).alias("at"), F.lit(action).alias("action"), none.alias("version"), name.alias("name")))

    parts = [later(k, "undo", id_ % 4 > k) for k in range(3)] + [later(3, "redo", id_ % 4 > 1), later(4, "rename", id_ % 5 == 0), later(5, "delete", id_ % 14 == 0), later(6, "clear", id_ % 14 == 7)]
    saves = orders.select("id", F.col("version").alias("at"), F.lit("save").alias("action"), "version", F.lit(None).cast("string").alias("name"))
    return saves, orders.select("id").distinct().select("id", F.inline(F.filter(F.array(*parts), lambda part: part.isNotNull())))


@query(_EDITS)
def undo_redo(spark, sf_dir):
    saves, rest = edits(spark, sf_dir)
    return history.after_log(saves.unionByName(rest))


@query(_EDITS)
def undo_redo_stream(spark, sf_dir):
    """The same actions as they arrive, saves before the rest, with histories as state."""
    folder, out, old = new_path(spark, "actions"), new_path(spark, "items"), spark.conf.get(history.STORE, None)
    saves, rest = edits(spark, sf_dir)
    saves.write.json(folder)
    rest.write.mode("append").json(folder)
    spark.conf.set(history.STORE, history.ROCKS)
    try:
        history.started(spark, spark.readStream.schema(history.ACTIONS).json(folder), out, f"{out}-log").awaitTermination()
    finally:
        spark.conf.unset(history.STORE) if old is None else spark.conf.set(history.STORE, old)
    return Versions(spark, out, f"{out}-log").latest().where("version IS NOT NULL")


_CUT = f"""WITH r AS (SELECT p_partkey, '{REF_A}' AS ref, substring('{REF_A}', CAST(p_partkey % 75 + 1 AS INT), 20) AS guide, p_partkey % 75 AS start, p_partkey % 2 = 0 AS reverse FROM part),
 m AS (SELECT *, regexp_matches(substring(ref, CAST(start + 21 AS INT), 3), '^[ACGT]GG$') AS rp, start >= 3 AND regexp_matches(substring(ref, CAST(greatest(start - 2, 1) AS INT), 3), '^CC[ACGT]$') AS lp FROM r),
 c AS (SELECT *, CASE WHEN rp THEN start + 17 WHEN regexp_matches(guide, '[ACGT]GG$') THEN start + 14 END AS f, CASE WHEN lp THEN start + 3 WHEN regexp_matches(guide, '^CC[ACGT]') THEN start + 6 END AS v FROM m)
 SELECT p_partkey, coalesce(CASE WHEN reverse THEN coalesce(v, f) ELSE coalesce(f, v) END, -1) AS cut FROM c"""


@query(_CUT)
def annotation_cut_site(spark, sf_dir):
    start = F.col("p_partkey") % 75
    ref = F.lit(REF_A)
    return table(spark, sf_dir, "part").select("p_partkey", workspace.annotation_cut(ref, F.substring(ref, (start + 1).cast("int"), F.lit(20)), start, F.col("p_partkey") % 2 == 0, F.lit(-1)).alias("cut"))


def _exact_site_sql() -> str:
    return f"""WITH r AS (SELECT p_partkey, CAST(p_partkey % 40 AS INT) AS k FROM part), s AS (SELECT p_partkey, concat(repeat('A', k), '{REF_A}') AS sequence, k FROM r)
    SELECT p_partkey, true AS matched, true AS exact, 'forward' AS strand, k + 47 AS start, k + 64 AS cut, 'AGG' AS pam FROM s"""


@query(_exact_site_sql())
def cut_site(spark, sf_dir):
    k = F.col("p_partkey") % 40
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.repeat(F.lit("A"), k.cast("int")), F.lit(REF_A)).alias("sequence"), F.lit(GUIDE_A).alias("query"))
    return homoeolog.guide_sites(rows).select("p_partkey", "matched", "exact", "strand", "start", "cut", "pam")


@query(
    f"""WITH r AS (SELECT p_partkey, CAST(p_partkey % 40 AS INT) AS k FROM part), s AS (SELECT p_partkey, concat(repeat('A', k), '{REF_A}') AS sequence FROM r),
    p AS (SELECT p_partkey, sequence, CAST(unnest(range(0, length(sequence) - 19)) AS INT) AS pos FROM s),
    b AS (SELECT p_partkey, pos, substring(sequence, pos + 1, 20) AS spacer, substring(sequence, pos + 21, 3) AS after, CASE WHEN pos >= 3 THEN substring(sequence, pos - 2, 3) ELSE '' END AS before FROM p),
    c AS (SELECT p_partkey, pos, 'forward' AS strand, CAST(len(list_filter(range(1, 21), lambda i: substring(spacer, CAST(i AS INT), 1) <> substring('{GUIDE_B}', CAST(i AS INT), 1))) AS INT) AS mismatches, regexp_matches(after, '^.GG$') AS pam FROM b
      UNION ALL SELECT p_partkey, pos, 'reverse', CAST(len(list_filter(range(1, 21), lambda i: substring(spacer, CAST(i AS INT), 1) <> substring('{GUIDE_B[::-1].translate(str.maketrans("ACGT", "TGCA"))}', CAST(i AS INT), 1))) AS INT), regexp_matches(before, '^CC.$') FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY mismatches, pam DESC, pos, strand) AS nth FROM c)
    SELECT p_partkey, mismatches, strand, pos AS start, CASE strand WHEN 'forward' THEN pos + 17 ELSE pos + 3 END AS cut, pam AS pam_found FROM n WHERE nth = 1"""
)
def homoeolog_guide_site(spark, sf_dir):
    k = F.col("p_partkey") % 40
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.repeat(F.lit("A"), k.cast("int")), F.lit(REF_A)).alias("sequence"), F.lit(GUIDE_B).alias("query"))
    return homoeolog.guide_sites(rows).select("p_partkey", "mismatches", "strand", "start", "cut", "pam_found")


_RATES = "SELECT s_nationkey AS grp, s_suppkey AS copy, CAST(s_suppkey % 97 AS DOUBLE) AS rate, s_suppkey % 13 AS aligned_reads FROM supplier"


def _rates(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), k.alias("copy"), (k % 97).cast("double").alias("rate"), (k % 13).alias("aligned_reads"))


@query(f"WITH r AS ({_RATES}) SELECT grp, avg(rate) AS mean_rate, max(rate) - min(rate) AS spread, CAST(sum(aligned_reads) AS BIGINT) AS reads FROM r GROUP BY grp")
def editing_spread(spark, sf_dir):
    return homoeolog.editing_spread(_rates(spark, sf_dir), "grp")


@query(
    f"""WITH r AS ({_RATES}), p AS (SELECT grp, list(rate / 100 ORDER BY copy) AS e, max(rate) AS hi, min(rate) AS lo FROM r GROUP BY grp),
    m AS (SELECT *, list_product(e) AS every, list_product(list_transform(e, lambda x: 1 - x)) AS none FROM p)
    SELECT grp, round(every * 100, 9) AS p_both, round(none * 100, 9) AS p_none, round((1 - none) * 100, 9) AS p_at_least_one,
    round(CASE WHEN len(e) = 2 THEN e[1] * (1 - e[2]) + e[2] * (1 - e[1]) ELSE greatest(0, 1 - none - every) END * 100, 9) AS p_single,
    round(CASE WHEN hi > 0 THEN lo / hi * 100 ELSE 100 END, 9) AS parity, round(CASE WHEN lo > 0 THEN hi / lo WHEN hi > 0 THEN 999 ELSE 1 END, 9) AS bias FROM m"""
)
def coedit_independence(spark, sf_dir):
    out = homoeolog.coedit_independence(_rates(spark, sf_dir), "grp", "copy")
    return out.select("grp", *(F.round(c, 9).alias(c) for c in out.columns if c != "grp"))


@query(
    """WITH r AS (SELECT concat('g', CAST(l_suppkey % 4 AS VARCHAR)) AS gene, CASE l_linenumber % 3 WHEN 0 THEN 'In-frame' WHEN 1 THEN 'Out-of-frame' ELSE 'No indel' END AS classification, CAST(l_partkey % 31 - 15 AS INT) AS net_indel, l_quantity * 1.0e0 AS read_pct FROM lineitem),
    p AS (SELECT concat(classification, ' [', CASE WHEN net_indel >= 0 THEN '+' ELSE '' END, CAST(net_indel AS VARCHAR), 'bp]') AS allele_key, gene, max(read_pct) AS pct FROM r GROUP BY ALL)
    SELECT allele_key, count(*) > 1 AS shared, sum(pct) / 4.0e0 AS mean_pct FROM p GROUP BY allele_key ORDER BY shared DESC, mean_pct DESC, allele_key LIMIT 15"""
)
def shared_alleles_top15(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("g"), (F.col("l_suppkey") % 4).cast("string")).alias("gene"), F.when(k == 0, "In-frame").when(k == 1, "Out-of-frame").otherwise("No indel").alias("classification"), (F.col("l_partkey") % 31 - 15).cast("int").alias("net_indel"), F.col("l_quantity").cast("double").alias("read_pct"), F.lit("x").alias("read_inner"))
    return homoeolog.shared_alleles(rows, 4)


_WINDOWS = "SELECT n_nationkey AS ix, concat(substring('{a}', 1, CAST(30 + n_nationkey AS INT)), substring('{b}', CAST(20 + n_nationkey * 2 AS INT), 40)) AS seq FROM nation".format(a=REF_A, b=REF_B)


@query(f"WITH w AS ({_WINDOWS}) SELECT a.ix AS a, b.ix AS b, CAST(levenshtein(a.seq, b.seq) AS INT) AS distance FROM w a JOIN w b ON a.ix < b.ix")
def similarity_pairs(spark, sf_dir):
    return _window_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a_seq", "b_seq").alias("distance"))


@query()
def reference_identity(spark, sf_dir):
    return homoeolog.similarity(_window_pairs(spark, sf_dir)).select("a", "b", "identity", "ratio", "difference_bp", "aligned")


def _window_pairs(spark, sf_dir):
    k = F.col("n_nationkey")
    seq = F.concat(F.substring(F.lit(REF_A), F.lit(1), (k + 30).cast("int")), F.substring(F.lit(REF_B), (k * 2 + 20).cast("int"), F.lit(40)))
    return homoeolog.window_pairs(table(spark, sf_dir, "nation").select(k.alias("ix"), seq.alias("seq")))


_COPIES = f"""WITH r AS (SELECT concat('G', CAST(n_regionkey AS VARCHAR)) AS homoeolog_group, n_nationkey AS gene_ix, (n_nationkey * 7) % 5 * 2 AS k, n_nationkey % 2 AS odd FROM nation),
 a AS (SELECT *, first_value(gene_ix) OVER w AS anchor_ix, first_value(k) OVER w AS ka, first_value(odd) OVER w AS odd_a FROM r WINDOW w AS (PARTITION BY homoeolog_group ORDER BY k, gene_ix)),
 s AS (SELECT *, floor((2.0e0 * (100 - k) / (200 - k - ka)) * 1000.0e0 + 0.5e0) / 10.0e0 AS similarity FROM a)
SELECT homoeolog_group, gene_ix, gene_ix = anchor_ix AS is_anchor, 't1' AS target_id, similarity, true AS aligned, CAST(60 - ka AS INT) AS guide_from, CAST(80 - ka AS INT) AS guide_to, CAST(20 - ka AS INT) AS window_from, CAST(95 - ka AS INT) AS window_to,
  (70 - ka) / (100.0e0 - ka) * 100.0e0 AS left_pct, CAST(CASE WHEN odd = odd_a THEN 0 ELSE 1 END AS INT) AS window_difference_bp, NULL AS error FROM s
UNION ALL SELECT homoeolog_group, gene_ix, gene_ix = anchor_ix, 't2', similarity, true, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN gene_ix % 4 = 0 THEN 'no guide' ELSE 'Guide not matched' END
  FROM s WHERE homoeolog_group IN (SELECT homoeolog_group FROM r WHERE gene_ix % 4 = 0)"""


@query(_COPIES)
def homoeolog_markers(spark, sf_dir):
    """Copies that lack some bases at their start, every second with a base changed in its window; a second target that few have, without a cut."""
    n, ref = F.col("n_nationkey"), F.lit(REF_A)
    k = ((n * 7) % 5 * 2).cast("int")
    nations = table(spark, sf_dir, "nation").withColumn("k", k)
    refs = nations.select(F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("homoeolog_group"), n.alias("gene_ix"), F.substring(ref, F.col("k") + 1, F.lit(100)).alias("sequence"))
    window = F.when(n % 2 == 1, F.concat(F.lit("N"), F.substring(ref, F.lit(22), F.lit(74)))).otherwise(F.substring(ref, F.lit(21), F.lit(75)))
    spot = lambda at, name: (F.lit(at) - F.col("k")).alias(name)
    one = nations.select(n.alias("gene_ix"), F.lit("t1").alias("target_id"), spot(77, "cut"), spot(60, "guide_from"), spot(80, "guide_to"), spot(20, "window_from"), spot(95, "window_to"), window.alias("window_seq"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("int")
    two = nations.where(n % 4 == 0).select(n.alias("gene_ix"), F.lit("t2").alias("target_id"), F.lit(-1).alias("cut"), *(none.alias(c) for c in ("guide_from", "guide_to", "window_from", "window_to")), F.lit("").alias("window_seq"), F.lit("no guide").alias("error"))
    return homoeolog.markers(refs, one.unionByName(two))


def _copies_of_regions(spark, sf_dir):
    """A copy a nation, of a gene a region: bases missing at one place, others put in at another, one changed."""
    n, ref = F.col("n_nationkey"), F.lit(REF_A)
    seq = F.concat(F.substring(ref, F.lit(1), F.lit(30)), F.substring(F.lit("TTTTGGGG"), F.lit(1), (n % 5).cast("int")), F.substring(ref, (31 + n % 3).cast("int"), (30 - n % 3).cast("int")), F.when(n % 2 == 1, "N").otherwise(F.substring(ref, F.lit(61), F.lit(1))), F.substring(ref, F.lit(62), F.lit(39)))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("homoeolog_group"), n.alias("gene_ix"), seq.alias("sequence"))


_REGIONS = f"""WITH r AS (SELECT concat('G', CAST(n_regionkey AS VARCHAR)) AS homoeolog_group, n_nationkey AS gene_ix, concat(substring('{REF_A}', 1, 30), substring('TTTTGGGG', 1, CAST(n_nationkey % 5 AS INT)),
  substring('{REF_A}', CAST(31 + n_nationkey % 3 AS INT), CAST(30 - n_nationkey % 3 AS INT)), CASE WHEN n_nationkey % 2 = 1 THEN 'N' ELSE substring('{REF_A}', 61, 1) END, substring('{REF_A}', 62, 39)) AS seq FROM nation),
 a AS (SELECT *, first_value(gene_ix) OVER (PARTITION BY homoeolog_group ORDER BY length(seq) DESC, gene_ix) AS anchor_ix FROM r)"""


@query(f"{_REGIONS} SELECT homoeolog_group, gene_ix, gene_ix = anchor_ix AS is_anchor, true AS aligned, seq AS rebuilt, seq AS from_tokens, true AS as_wide FROM a")
def homoeolog_columns(spark, sf_dir):
    """Copies on shared columns: without its gaps each row is the copy again, and all rows of a group are equally wide."""
    s = columns.star_alignment(_copies_of_regions(spark, sf_dir))
    widest = s.groupBy(F.col("homoeolog_group").alias("g")).agg(F.max(F.length("laid")).alias("width"))
    kept = F.array_join(F.transform(F.filter("tokens", lambda t: t["type"] != "delete"), lambda t: t["val"]), "")
    return s.join(widest, F.col("homoeolog_group") == F.col("g")).select("homoeolog_group", "gene_ix", "is_anchor", "aligned", F.replace("laid", F.lit("-"), F.lit("")).alias("rebuilt"), kept.alias("from_tokens"), (F.length("laid") == F.col("width")).alias("as_wide"))


@query(f"""{_REGIONS}, d AS (SELECT s.homoeolog_group, s.gene_ix, length(t.seq) - length(s.seq) AS more FROM a s JOIN a t ON s.homoeolog_group = t.homoeolog_group AND t.gene_ix = s.anchor_ix WHERE s.gene_ix <> s.anchor_ix)
 SELECT homoeolog_group, gene_ix, CAST(more AS BIGINT) AS more FROM d""")
def homoeolog_differences(spark, sf_dir):
    """Where copies differ from their anchor: the marks add up to the difference in length."""
    copies = _copies_of_regions(spark, sf_dir)
    marks = columns.lane_differences(copies).groupBy(F.col("homoeolog_group").alias("g"), F.col("gene_ix").alias("i")).agg(F.sum((F.col("anchor_to") - F.col("anchor_from")) - (F.col("ref_to") - F.col("ref_from"))).alias("more"))
    lanes = columns.star_alignment(copies).where("not is_anchor").select("homoeolog_group", "gene_ix")
    return lanes.join(marks, (F.col("homoeolog_group") == F.col("g")) & (F.col("gene_ix") == F.col("i")), "left").select("homoeolog_group", "gene_ix", F.coalesce("more", F.lit(0)).alias("more"))
