"""Inputs made from the driver's tables: amplicon reads from orders, DNA from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import AnalysisConfig, Gene, Target

#: Two similar references and their guides.
REF_A = "GTCACTGACATTGCAGCCTAAGCTTGACGTACCATGGATTCAGCTAGCATCGATTACAGATCCGGATAGGCTTAACGTCCATGAGTCGCAATTGCTCAGG"
REF_B = "GTCACTGACATTGCAGCCGAAGCTAGACGTACCTTGGATTCAGCTAGCATCGATTACAGATCCGGACAGGCTTAGCGTCCTTGAGTCGCAATTGCTCAGG"
GUIDE_A, GUIDE_B, GUIDE_A2 = "CATCGATTACAGATCCGGAT", "CATCGATTACAGATCCGGAC", "GCTAGCATCGATTACAGATC"

# windows that cover the whole references: with 90 bases, some insertions push a read's crop for the other gene into its differing left end
GENE_A, GENE_B = (Gene(n, ref, (Target("t1", guide, window_left=64, window_right=36),)) for n, ref, guide in (("A", REF_A, GUIDE_A), ("B", REF_B, GUIDE_B)))
GENE_A90 = Gene("A", REF_A, (Target("t1", GUIDE_A),))
TWO_GENES = AnalysisConfig((GENE_A, GENE_B), phred=20.0, margin=0.02)
TWO_TARGETS = AnalysisConfig((Gene("A", REF_A, (*GENE_A.targets, Target("t2", GUIDE_A2, window_left=59, window_right=41))), GENE_B), phred=20.0, margin=0.02)
#: A target whose guide isn't in its reference, and a gene that no read is of.
WITH_GAPS = AnalysisConfig((Gene("A", REF_A, (*GENE_A.targets, Target("gone", "AAAAACCCCCGGGGGTTTTT"))), GENE_B, Gene("C", "AT" * 20 + "GGCCAATTGGCCAAGGTTCC" + "AGG" + "TA" * 20, (Target("t1", "GGCCAATTGGCCAAGGTTCC"),))), phred=20.0, margin=0.02)
TWINS = AnalysisConfig((GENE_A, Gene("A2", REF_A, GENE_A.targets)), phred=20.0, margin=0.02, rescue=True, analyze_ambiguous=True)

_MOLECULE = f"""o_orderkey AS read_index,
  CASE WHEN o_custkey % 4 = 0 THEN 'B' ELSE 'A' END AS true_gene,
  CASE WHEN o_custkey % 4 = 0 THEN '{REF_B}' ELSE '{REF_A}' END AS ref,
  CAST(58 + o_custkey % 12 AS INT) AS p,
  CAST(CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 7 ELSE 0 END AS INT) AS del,
  CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_custkey % 5 ELSE 0 END AS INT) AS ins,
  o_orderkey % 5 = 0 AS is_rc,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 10 ELSE 35 END AS INT) AS q,
  concat('f', CAST(o_orderkey % 3 AS VARCHAR(9))) AS file"""
_FORWARD = "concat(substring(ref, 1, p), substring('TTGACCATG', 1, ins), substring(ref, p + del + 1, 100))"
_READ = """read_index, true_gene, ins - del AS true_net, is_rc, q, file, fwd, concat('r', CAST(read_index AS VARCHAR(20))) AS read_id,
  CASE WHEN is_rc THEN reverse(translate(fwd, 'ACGT', 'TGCA')) ELSE fwd END AS seq, repeat(chr(q + 33), CAST(length(fwd) AS INT)) AS qual"""

#: The reads as the start of a DuckDB query.
READS = f"WITH molecules AS (SELECT {_MOLECULE} FROM orders), strands AS (SELECT *, {_FORWARD} AS fwd FROM molecules), reads AS (SELECT {_READ} FROM strands)"
#: Reads that can be used, with their true allele, class and net change.
TRUTH = READS + """, truth AS (SELECT *, fwd AS allele,
  CASE WHEN true_net = 0 THEN 'no_indel' WHEN true_net % 3 = 0 THEN 'in_frame' ELSE 'out_of_frame' END AS category FROM reads WHERE q >= 20)"""
#: Reads that fail or differ, a kind an order; what becomes of each is known from its kind.
KINDS = (
    "plain", "substituted", "no_left_end", "no_right_end", "short", "strange", "spoiled_end", "low", "mixed_good", "mixed_bad", "substituted_and_deleted", "between",
)
#: Half of the places where the references differ from one, half from the other: as near to both.
BETWEEN = "".join(a if a == b or sum(x != y for x, y in zip(REF_A[:i], REF_B[:i], strict=True)) % 2 == 0 else b for i, (a, b) in enumerate(zip(REF_A, REF_B, strict=True)))
_HARD = f"""o_orderkey AS read_index, o_custkey % 12 AS kind, concat('f', CAST(o_orderkey % 3 AS VARCHAR(9))) AS file, o_orderkey % 5 = 0 AS is_rc, CASE WHEN o_orderkey % 4 = 0 THEN 'B' ELSE 'A' END AS true_gene, CASE WHEN o_orderkey % 4 = 0 THEN '{REF_B}' ELSE '{REF_A}' END AS ref"""
_CHANGED = "concat(substring(ref, 1, 41), translate(substring(ref, 42, 1), 'ACGT', 'CGTA'), substring(ref, 43, 100))"
_HARD_BASES = f"""CASE kind WHEN 1 THEN {_CHANGED} WHEN 2 THEN substring(ref, 11, 100) WHEN 3 THEN substring(ref, 1, 90) WHEN 4 THEN substring(ref, 1, 76) WHEN 5 THEN repeat('AC', 40) WHEN 6 THEN concat(substring(ref, 1, 85), repeat('T', 15))
  WHEN 10 THEN concat(substring({_CHANGED}, 1, 64), substring({_CHANGED}, 68, 100)) WHEN 11 THEN '{BETWEEN}' ELSE ref END"""
_HARD_READ = """read_index, kind, file, is_rc, true_gene, ref, fwd, concat('h', CAST(read_index AS VARCHAR(20))) AS read_id, CASE WHEN is_rc THEN reverse(translate(fwd, 'ACGT', 'TGCA')) ELSE fwd END AS seq,
  CASE kind WHEN 7 THEN repeat(chr(43), 100) WHEN 8 THEN repeat(concat(chr(43), chr(73)), 50) WHEN 9 THEN repeat(concat(chr(43), chr(58)), 50) ELSE repeat(chr(68), CAST(length(fwd) AS INT)) END AS qual"""
HARD = f"WITH hard_orders AS (SELECT {_HARD} FROM orders), hard_bases AS (SELECT *, {_HARD_BASES} AS fwd FROM hard_orders), hard AS (SELECT {_HARD_READ} FROM hard_bases)"

_DNA_LETTERS = "ACGTACGTACGTACGTACGTACGTAC"
#: DNA from the whole text of documents.
DNA = f"WITH dna AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{_DNA_LETTERS}') AS seq FROM documents)"


def _columns(text: str) -> list[str]:
    """Top-level commas part a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in (*out, text[at:])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_index, true_gene, true_net, is_rc, q, file, fwd, read_id, seq, qual: one read an order."""
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(*_columns(_MOLECULE)).selectExpr("*", f"{_FORWARD} AS fwd").selectExpr(*_columns(_READ))


def hard_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_index, kind, file, is_rc, true_gene, ref, fwd, read_id, seq, qual: one read an order, of one of KINDS."""
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(*_columns(_HARD)).selectExpr("*", f"{_HARD_BASES} AS fwd").selectExpr(*_columns(_HARD_READ))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: the letters of each document as bases."""
    letters = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''), 'abcdefghijklmnopqrstuvwxyz', '{_DNA_LETTERS}') AS seq"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", letters)
