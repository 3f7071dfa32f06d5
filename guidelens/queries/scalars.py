"""Functions of sequences, qualities and names, over reads and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequence as S
from ..functions.sql import register
from ..kernels.cutsite import windows_of
from .fixtures import DNA, GUIDE_A, GUIDE_B, READS, REF_A, REF_B, TWO_GENES, dna, reads, table
from .registry import query

WINDOW = windows_of(TWO_GENES.genes)[0].ref
IUPAC_TAIL = "'RYSWKMBDHVNUXacgtryswkmbdhvn-'"


def rows(spark, sf_dir):
    return reads(spark, sf_dir)


@query(f"{READS} SELECT read_index, reverse(translate(regexp_replace(upper(seq), '[^ACGTNX]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc FROM reads")
def reverse_complement(spark, sf_dir):
    return rows(spark, sf_dir).select("read_index", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"{READS} SELECT read_index, reverse(translate(concat(seq, {IUPAC_TAIL}), 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) AS rc FROM reads")
def iupac_reverse_complement(spark, sf_dir):
    return rows(spark, sf_dir).select("read_index", S.reverse_complement_iupac(F.concat("seq", F.expr(IUPAC_TAIL))).alias("rc"))


@query(f"{DNA} SELECT doc_id, CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GCSgcs]', '', 'g')) * 1.0e0 / length(seq) * 100 ELSE 0.0e0 END AS gc FROM dna")
def gc_content(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", S.gc_content(F.col("seq")).alias("gc"))


@query(f"{READS} SELECT read_index, q * 1.0e0 AS phred FROM reads")
def avg_phred(spark, sf_dir):
    return rows(spark, sf_dir).select("read_index", S.avg_phred(F.col("qual")).alias("phred"))


@query(
    f"""{READS}, p AS (SELECT read_index, n, substring(seq, 1, n) AS primer FROM reads, (SELECT unnest([10, 13, 14, 20]) AS n))
    SELECT read_index, CAST(n AS INT) AS n, CASE WHEN n < 14 THEN length(regexp_replace(primer, '[^AT]', '', 'g')) * 2.0e0 + length(regexp_replace(primer, '[^CG]', '', 'g')) * 4.0e0
      ELSE (length(regexp_replace(primer, '[^CG]', '', 'g')) - 16.4e0) * 41.0e0 / length(primer) + 64.9e0 END AS tm FROM p"""
)
def melting_temp(spark, sf_dir):
    primers = rows(spark, sf_dir).select("read_index", "seq", F.explode(F.array(*map(F.lit, (10, 13, 14, 20)))).alias("n"))
    return primers.select("read_index", "n", S.melting_temp(F.substring(F.col("seq"), F.lit(1), F.col("n"))).alias("tm"))


@query(
    f"""{READS} SELECT read_index, CASE WHEN true_net = 0 THEN 'no_indel' WHEN true_net % 3 = 0 THEN 'in_frame' ELSE 'out_of_frame' END AS frame FROM reads"""
)
def frame_rule(spark, sf_dir):
    net = F.col("true_net")
    return rows(spark, sf_dir).select("read_index", S.frame(F.greatest(net, F.lit(0)), F.greatest(-net, F.lit(0))).alias("frame"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(l_quantity AS INT) AS d FROM lineitem), s AS (SELECT d, 1.0e0 / (1.0e0 + exp(-0.35e0 * (d - 10))) AS here,
    1.0e0 / (1.0e0 + exp(3.5e0)) AS low, 1.0e0 / (1.0e0 + exp(-0.35e0 * 35)) AS high FROM d)
    SELECT d, round(1.0e0 + 2.0e0 * greatest(0.0e0, least(1.0e0, (here - low) / (high - low))), 9) AS weight FROM s"""
)
def seagull_weight(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("d")).distinct()
    return d.select("d", F.round(S.seagull_weight(F.col("d"), F.lit(45), 2.0), 9).alias("weight"))


@query("SELECT p_partkey, CAST(greatest(0, p_size * 4 - p_partkey % 120 // 2) AS BIGINT) AS a, CAST(least(100, p_size * 4 + p_partkey % 120 // 2) AS BIGINT) AS b FROM part")
def window_bounds(spark, sf_dir):
    cut, size = F.col("p_size") * 4, F.col("p_partkey") % 120
    return table(spark, sf_dir, "part").select("p_partkey", S.window_start(cut, size).cast("bigint").alias("a"), S.window_end(F.lit(100), cut, size).cast("bigint").alias("b"))


def _offset_sql() -> str:
    rc = GUIDE_A[::-1].translate(str.maketrans("ACGT", "TGCA"))
    hit = lambda m, back: f"CASE WHEN instr(fwd, '{m}') > 0 THEN instr(fwd, '{m}') - 1 - {back} END"
    ways = [hit(m, WINDOW.index(m)) for m in (GUIDE_A, rc) if m in WINDOW] + [hit(WINDOW[:15], 0), hit(WINDOW[-15:], len(WINDOW) - 15)]
    return f"{READS} SELECT read_index, CAST(coalesce({', '.join(ways)}) AS INT) AS place FROM reads"


@query(_offset_sql())
def offset_exact(spark, sf_dir):
    return rows(spark, sf_dir).select("read_index", S.offset_of(F.col("fwd"), WINDOW, GUIDE_A).cast("int").alias("place"))


@query(f"{READS} SELECT read_index, CAST(least(levenshtein(substring(fwd, 50, 30), '{REF_A[49:79]}'), 5) AS INT) AS edits FROM reads")
def bounded_edit_distance(spark, sf_dir):
    return rows(spark, sf_dir).select("read_index", S.bounded_distance(F.substring("fwd", 50, 30), F.lit(REF_A[49:79])).alias("edits"))


@query(
    f"""{READS}, w AS (SELECT read_index, substring(fwd, 48, 20) AS w FROM reads) SELECT read_index,
    CAST(len(list_filter(range(1, least(length(w), 20) + 1), lambda i: substring(w, i, 1) <> substring('{REF_B[47:67]}', i, 1))) + abs(length(w) - 20) AS INT) AS mismatches FROM w"""
)
def hamming_mismatch(spark, sf_dir):
    return rows(spark, sf_dir).select("read_index", S.mismatches(F.substring("fwd", 48, 20), F.lit(REF_B[47:67])).cast("int").alias("mismatches"))


def _translate_sql() -> str:
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    table_sql = ", ".join(f"'{c}': '{x}'" for c, x in zip(codons, S.AMINO_ACIDS, strict=True))
    return f"""{DNA} SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(seq, '[ACGT]{{3}}'), lambda c: (MAP {{{table_sql}}})[c]), ''), '') AS protein FROM dna"""


@query(_translate_sql())
def translate_dna(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", S.translate_dna(F.col("seq")).alias("protein"))


@query(
    f"""{READS}, s AS (SELECT read_index, concat('XX', substring(seq, 1, 30), 'XXXX', substring(seq, 40, 100), 'X') AS s FROM reads)
    SELECT read_index, array_to_string(regexp_extract_all(s, '[^X]+'), ',') AS segments, CAST(length(regexp_extract(s, '^X+')) AS INT) AS lead, CAST(length(regexp_extract(s, 'X+$')) AS INT) AS trail FROM s"""
)
def observed_segments(spark, sf_dir):
    s = rows(spark, sf_dir).select("read_index", F.concat(F.lit("XX"), F.substring("seq", 1, 30), F.lit("XXXX"), F.substring("seq", 40, 100), F.lit("X")).alias("s"))
    return s.select("read_index", F.array_join(S.observed_segments(F.col("s")), ",").alias("segments"), S.leading_x(F.col("s")).alias("lead"), S.trailing_x(F.col("s")).alias("trail"))


@query(
    f"""{READS}, s AS (SELECT read_index, seq, concat('!!', substring(qual, 1, 30), '!!!!', substring(qual, 40, 100), '!') AS q FROM reads)
    SELECT read_index, 2 AS "start", 32 AS "end", substring(seq, 1, 30) AS seq, substring(q, 3, 30) AS qual FROM s
    UNION ALL SELECT read_index, 36, CAST(36 + length(seq) - 39 AS INT), substring(seq, 40, 100), substring(q, 37, CAST(length(seq) - 39 AS INT)) FROM s"""
)
def segment_offsets(spark, sf_dir):
    pad = lambda c, x: F.concat(F.lit(x * 2), F.substring(c, 1, 30), F.lit(x * 4), F.substring(c, 40, 100), F.lit(x))
    return rows(spark, sf_dir).select("read_index", F.inline(S.segments(pad("seq", "X"), pad("qual", "!"))))


@query(
    f"""{READS} SELECT read_index, CASE WHEN q >= 20 THEN 'ok' ELSE 'quality' END AS reason, CASE WHEN q >= 20 THEN is_rc END AS is_rc,
    CAST(least(levenshtein(fwd, ref), 5) AS INT) AS distance, CAST(CASE true_gene WHEN 'A' THEN position('{GUIDE_A}' IN ref) ELSE position('{GUIDE_B}' IN ref) END - 1 AS INT) AS guide_start
    FROM (SELECT *, CASE true_gene WHEN 'A' THEN '{REF_A}' ELSE '{REF_B}' END AS ref FROM reads)"""
)
def sql_functions(spark, sf_dir):
    """Kernels called from SQL text."""
    register(spark)
    one = rows(spark, sf_dir).withColumns({"ref": F.when(F.col("true_gene") == "A", REF_A).otherwise(REF_B), "guide": F.when(F.col("true_gene") == "A", GUIDE_A).otherwise(GUIDE_B)})
    return spark.sql(
        """SELECT read_index, l.reason, l.is_rc, distance, c.guide_start FROM (SELECT read_index, locate_target(seq, qual, ref, guide, 20.0D) AS l,
        edit_distance_within(fwd, ref, 4) AS distance, guide_cut_site(ref, guide) AS c FROM {reads})""",
        reads=one,
    )


@query(
    """WITH n AS (SELECT o_orderkey, concat('@r', CAST(o_orderkey AS VARCHAR), CASE o_orderkey % 3 WHEN 0 THEN '/1' WHEN 1 THEN '/2 1:N:0' ELSE ' 2:N:0' END) AS name FROM orders)
    SELECT o_orderkey, regexp_replace(regexp_extract(regexp_replace(name, '^@', ''), '^\\s*(\\S*)', 1), '/[12]$', '') AS id FROM n"""
)
def normalize_read_id(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 3 == 0, "/1").when(F.col("o_orderkey") % 3 == 1, "/2 1:N:0").otherwise(" 2:N:0")
    name = F.concat(F.lit("@r"), F.col("o_orderkey").cast("string"), end)
    return table(spark, sf_dir, "orders").select("o_orderkey", names.read_id(name).alias("id"))


_FILE_SQL = """WITH f AS (SELECT p_partkey, concat('lab', CAST(p_size AS VARCHAR), CASE p_partkey % 6 WHEN 0 THEN '_S1_L001_R1_001.fastq.gz' WHEN 1 THEN '_S1_L001_R2_001.fastq.gz'
   WHEN 2 THEN '-x_1.fq' WHEN 3 THEN '-x_2.fq' WHEN 4 THEN '.r1.fastq' ELSE '_plain.fastq' END) AS name FROM part)"""


def _file_name():
    k = F.col("p_partkey") % 6
    end = F.when(k == 0, "_S1_L001_R1_001.fastq.gz").when(k == 1, "_S1_L001_R2_001.fastq.gz").when(k == 2, "-x_1.fq").when(k == 3, "-x_2.fq").when(k == 4, ".r1.fastq").otherwise("_plain.fastq")
    return F.concat(F.lit("lab"), F.col("p_size").cast("string"), end)


@query(
    f"""{_FILE_SQL} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' WHEN 2 THEN 'r1' WHEN 3 THEN 'r2' WHEN 4 THEN 'r1' END AS mate,
    CASE WHEN p_partkey % 6 < 2 THEN concat('lab', CAST(regexp_extract(name, 'lab([0-9]+)', 1) AS VARCHAR), '_s1_l001') WHEN p_partkey % 6 < 4 THEN concat(regexp_extract(name, '^lab[0-9]+'), '_x')
      WHEN p_partkey % 6 = 4 THEN regexp_extract(name, '^lab[0-9]+') ELSE concat(regexp_extract(name, '^lab[0-9]+'), '_plain') END AS sample_key,
    concat('Lab ', regexp_extract(name, 'lab([0-9]+)', 1), CASE WHEN p_partkey % 6 < 2 THEN ' S 1 L 001' WHEN p_partkey % 6 < 4 THEN ' X' WHEN p_partkey % 6 = 4 THEN '' ELSE ' Plain' END) AS sample,
    regexp_matches(name, '(?i)\\.(fastq|fq)(\\.gz)?$') AS is_fastq FROM f"""
)
def mate_filename(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", _file_name().alias("name"))
    c = F.col("name")
    return n.select("p_partkey", names.mate(c).alias("mate"), names.sample_key(c).alias("sample_key"), names.sample_name(c).alias("sample"), names.is_fastq(c).alias("is_fastq"))


@query(
    """SELECT p_partkey, concat_ws('/', p_brand, CASE WHEN p_type <> p_brand THEN p_type END, CASE WHEN p_name NOT IN (p_brand, p_type) THEN p_name END) AS aliases FROM part"""
)
def alias_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", names.merged_aliases(F.concat_ws("/", "p_brand", "p_type"), F.concat_ws("/", "p_type", "p_name", "p_brand")).alias("aliases"))
