"""Files in and out: FASTQ, FASTA, GenBank, streaming, and operators that queries don't reach."""

import gzip
import io
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidelens.config import AnalysisConfig
from guidelens.functions import names
from guidelens.operators import export, merge, pairs, references, summary, workspace
from guidelens.operators.alleles import kept
from guidelens.operators.assign import assigned
from guidelens.plans.analysis import paired_reads, run_analysis
from guidelens.queries.fixtures import GENE_A, GENE_B, GUIDE_A, REF_A, REF_B, TWO_GENES
from guidelens.sources import fastq, sequences, splits
from guidelens.streaming import alleles as stream
from guidelens.streaming.versions import Versions

FASTQ = "@r1 x\nACGT\n+\nIIII\n\n@r2\nGGCC\n+\n@III\nnoise\n@empty\n\n+\n\n@r3\nTT\n+\n"


def test_records():
    assert list(fastq.records(FASTQ.splitlines(True))) == [("r1 x", "ACGT", "IIII"), ("r2", "GGCC", "@III")]
    assert [r[0] for r in fastq.records(FASTQ.splitlines(True), keep_empty=True, token_ids=True)] == ["r1", "r2", "empty"]


def test_fastq_source(spark, tmp_path):
    fastq.register(spark)
    (tmp_path / "a.fastq").write_text(FASTQ)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(FASTQ)
    (tmp_path / "c.txt").write_text("no reads")
    rows = spark.read.format("fastq").load(str(tmp_path)).orderBy("file", "read_index").collect()
    assert [(r.file, r.read_index, r.seq) for r in rows] == [("a.fastq", 0, "ACGT"), ("a.fastq", 1, "GGCC"), ("b.fq.gz", 0, "ACGT"), ("b.fq.gz", 1, "GGCC")]
    again = fastq.read_binary(spark, f"{tmp_path}/*.f*q*").orderBy("file", "read_index").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in again]


def test_round_trip(spark, tmp_path):
    fastq.register(spark)
    reads = spark.createDataFrame([(0, "x", "ACGT", "IIII"), (1, None, "GG", "!!")], "read_index long, read_id string, seq string, qual string")
    text = reads.select(export.fastq_record(F.col("read_id"), F.col("seq"), F.col("qual"), F.col("read_index")).alias("v"))
    text.coalesce(1).write.text(str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part*"))
    part.rename(tmp_path / "r.fastq")
    assert [(r.read_id, r.seq, r.qual) for r in spark.read.format("fastq").load(str(tmp_path / "r.fastq")).orderBy("read_index").collect()] == [("x", "ACGT", "IIII"), ("read_2", "GG", "!!")]
    assert spark.range(1).select(export.quality_string(F.array(F.lit(-3), F.lit(0), F.lit(200)))).first()[0] == "!!~"


GENBANK = """LOCUS       pTest 24 bp    DNA     circular   01-JAN-2020
DEFINITION  A test
FEATURES             Location/Qualifiers
     source          1..24
     CDS             complement(3..8)
                     /gene="abc"
                     /note="one
                     two"
     misc            join(2..4,9..12)
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 acgt
//
"""


def test_sequence_files(spark, tmp_path):
    d = sequences.genbank(GENBANK)
    assert (d["name"], d["topology"], d["sequence"]) == ("pTest", "circular", "ACGT" * 6)
    cds, misc = d["features"][1], d["features"][2]
    assert (cds["start"], cds["end"], cds["strand"], cds["name"], cds["qualifiers"]["note"]) == (2, 8, -1, "abc", ["one two"])
    assert (misc["start"], misc["end"], misc["strand"]) == (1, 12, 1)
    assert [x["name"] for x in sequences.fasta(">a\nAC\nGT\n>\nGG")] == ["a", "Untitled Sequence"]
    (tmp_path / "a.gb").write_text(GENBANK)
    (tmp_path / "b.fa").write_text(">s one\nAC GT\nAA\n>t\nCC\n")
    (tmp_path / "c.txt").write_text("ac-gt 12\n")
    rows = {(r.file, r.name): r for r in sequences.read_sequences(spark, str(tmp_path)).collect()}
    assert rows["b.fa", "s one"].sequence == "ACGTAA" and rows["c.txt", "c"].sequence == "ACGT" and len(rows["a.gb", "pTest"].features) == 3


def test_genbank_out_and_in(spark):
    feature = F.array(F.struct(F.lit("f").alias("name"), F.lit("CDS").alias("type"), F.lit(2).alias("start"), F.lit(8).alias("end"), F.lit(-1).alias("strand")))
    text = spark.range(1).select(export.genbank_record(F.lit("s"), F.lit("d"), F.lit("id"), F.lit("ACGT" * 20), F.lit("linear"), feature, F.lit("01-JAN-2020"))).first()[0]
    d = sequences.genbank(text)
    assert (d["sequence"], d["description"]) == ("ACGT" * 20, "d") and (d["features"][1]["start"], d["features"][1]["end"], d["features"][1]["strand"], d["features"][1]["name"]) == (2, 8, -1, "f")


def test_streamed_counts_equal_one_pass(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    reads = [REF_A, REF_A[:60] + REF_A[64:], REF_B, REF_A]
    for k in range(3):
        (folder / f"f{k}.fastq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    q = stream.started(spark, str(folder), TWO_GENES, str(tmp_path / "counts"), str(tmp_path / "ckpt"))
    assert q.awaitTermination(120)
    versions = Versions(spark, str(tmp_path / "counts"), str(tmp_path / "ckpt"))
    got = stream.result(versions.latest(), TWO_GENES).orderBy("gene_ix", "group_rank").collect()
    assert [(r.gene_ix, r.read_count, r.net_indel) for r in got] == [(0, 6, 0), (0, 3, -4), (1, 3, 0)]
    # a file that is renamed in late, with an old time, is read, and once; no file is read again
    late = tmp_path / "late"
    late.write_text("@r\n" + REF_B + "\n+\n" + "I" * len(REF_B) + "\n")
    os.utime(late, (1000, 1000))
    late.rename(folder / "a.fastq")
    for _ in range(2):
        assert stream.started(spark, str(folder), TWO_GENES, str(tmp_path / "counts"), str(tmp_path / "ckpt"), 1).awaitTermination(120)
        got = stream.result(versions.latest(), TWO_GENES).orderBy("gene_ix", "group_rank").collect()
        assert [(r.gene_ix, r.read_count) for r in got] == [(0, 6), (0, 3), (1, 4)]
    assert len(versions.numbers()) == 2


def test_streamed_records(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FASTQ)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(FASTQ)
    (tmp_path / "c.txt").write_text(FASTQ)
    q = fastq.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("streamed_records").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.file, r.read_index, r.seq) for r in spark.table("streamed_records").collect()) == [(f, i, s) for f in ("a.fastq", "b.fq.gz") for i, s in enumerate(("ACGT", "GGCC"))]


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["rows", "draft", "renamed", "manifests pruned"])
def test_versions_survive_a_crash(spark, tmp_path, step, monkeypatch):
    """A batch that fails at any step leaves a readable state, and counts once when it is run again."""
    more = lambda k: spark.createDataFrame([(0, 0, 0, "A", 0, 0, 10 ** k, k)], "gene_ix int, target_ix int, window int, read_window string, left_x int, right_x int, n long, first long")
    total = lambda v: v.latest().agg(F.sum("n")).first()[0]
    v = Versions(spark, str(tmp_path / "t"), "q")
    assert v.latest() is None
    for k in range(3):
        assert v.commit(k, lambda state, k=k: stream.added(state, more(k)))
    assert total(v) == 111 and v.numbers() == [1, 2]

    def fails(*_):
        raise Crash

    broken = Versions(spark, str(tmp_path / "t"), "q")
    if step == "rows":
        monkeypatch.setattr(broken, "publish", fails)
    elif step == "draft":
        files = broken.files
        broken.files = type("F", (), {"__getattr__": lambda _, n: fails if n == "rename" else getattr(files, n)})()
    elif step == "renamed":
        monkeypatch.setattr(broken, "prune", fails)
    else:

        def prune():
            broken.files.delete(broken.path(f"{broken.folder}/manifests/{broken.numbers()[0]:012d}.json"), False)
            fails()

        monkeypatch.setattr(broken, "prune", prune)
    with pytest.raises(Crash):
        broken.commit(3, lambda state: stream.added(state, more(3)))
    assert total(v) == (1111 if step in ("renamed", "manifests pruned") else 111)
    for _ in range(2):
        Versions(spark, str(tmp_path / "t"), "q").commit(3, lambda state: stream.added(state, more(3)))
        assert total(v) == 1111
    assert v.commit(4, lambda state: stream.added(state, more(4))) and total(v) == 11111
    with pytest.raises(ValueError, match="written by"):
        Versions(spark, str(tmp_path / "t"), "other").commit(9, lambda state: state)


def texts_for_splits():
    rng = random.Random(4)
    odd = ["", "@", "@@", "+", "noise", " @r", "ACGT", "@IIII", "acgt", "II II"]
    long = "".join(f"@r{i}\n{'ACGT' * rng.randrange(0, 9)}\n+\n{rng.choice('@I+')}{'I' * rng.randrange(0, 30)}\n" for i in range(400))
    yield long
    yield long[:-3]
    yield "\n".join(rng.choice(odd) for _ in range(3000))
    yield "\r\n".join(rng.choice(odd) for _ in range(500)) + "\r\n"
    yield "@r\n" + "A" * 5000 + "\n+\n" + "@" * 5000 + "\n@s\nA\n+\nI"
    yield ""
    yield "\n\n\n@a\nA\n+\nI\n@b\nA"


def test_splits_give_the_rows_of_one_task(spark, tmp_path):
    texts = list(texts_for_splits())
    for k, text in enumerate(texts):
        (tmp_path / f"f {k}.fastq").write_text(text, newline="")
    sizes = {"spark.sql.files.maxPartitionBytes": "160", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in sizes}
    for keep_empty, token_ids in ((False, False), (True, True)):
        want = sorted((f"f {k}.fastq", i, *r) for k, text in enumerate(texts) for i, r in enumerate(fastq.records(io.StringIO(text, newline=""), keep_empty, token_ids)))
        assert len(want) > 500
        try:
            for k, v in sizes.items():
                spark.conf.set(k, v)
            got = splits.read(spark, [str(tmp_path)], keep_empty, token_ids)
            assert got.rdd.getNumPartitions() > 100
            assert sorted(map(tuple, got.collect())) == want
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)


def test_block_functions_hold_few_lines():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5, 9, 40, 200):
        heads, bases, quals = ([rng.random() < share for _ in range(n)] for share in (0.4, 0.8, 0.9))
        want = []
        for case in range(4):
            at, count = (4 - case) % 4, 0
            out = case + n if at > n else None
            while out is None:
                at = next((i for i in range(at, n) if heads[i]), n)
                if at + 4 > n:
                    out = n - at
                else:
                    count, at = count + (bases[at + 1] and quals[at + 3]), at + 4
            want.append((out, count))
        for size in (1, 2, 3, 7, 1000):
            block = splits.BlockFunction()
            for low in range(0, n, size):
                block.add(*(np.array(x[low : low + size], bool) for x in (heads, bases, quals)), keep_empty=False)
                assert max(map(len, block.flags)) <= 3
            assert list(zip(*block.result(), strict=True)) == want


def test_large_files_are_not_rows(spark, tmp_path, monkeypatch):
    """A file over the limit never reaches parsed(), whatever its name and compression; the rows are the same."""
    for name in ("a [1]*{x}.fastq", "b.fq", "c.fq"):
        (tmp_path / name).write_text(FASTQ * 50)
    with gzip.open(tmp_path / "d.fq.gz", "wt", compresslevel=0) as f:
        f.write(FASTQ * 50)
    (tmp_path / "e.fq").write_bytes(FASTQ.replace("\n", "\r").encode())
    fastq.register(spark)
    want = sorted(map(tuple, spark.read.format("fastq").load(str(tmp_path)).collect()))
    held, parsed = [], fastq.parsed
    monkeypatch.setattr(fastq, "parsed", lambda files, *rest: held.append(files) or parsed(files, *rest))
    assert sorted(map(tuple, fastq.read_binary(spark, str(tmp_path), whole=1000).collect())) == want
    assert [r.path.rsplit("/", 1)[-1] for r in held[0].collect()] == ["e.fq"]
    assert sorted(map(tuple, fastq.read_binary(spark, str(tmp_path)).collect())) == want


def test_splits_of_block_gzip(spark, tmp_path):
    """Members cut anywhere in lines; ranges smaller than members, and much larger."""
    def member(data):
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packed.compress(data) + packed.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")

    texts = [t.replace("\r\n", "\n") for t in texts_for_splits()]
    rng, want, paths = random.Random(5), [], []
    for k, text in enumerate(texts):
        data, at, parts = text.encode(), 0, []
        while at < len(data):
            size = rng.choice([1, 40, 300, 4000])
            parts.append(member(data[at : at + size]))
            at += size
        (tmp_path / f"{k}.fastq.gz").write_bytes(b"".join(parts) + member(b""))
        paths.append(str(tmp_path / f"{k}.fastq.gz"))
        assert gzip.decompress((tmp_path / f"{k}.fastq.gz").read_bytes()) == data
        want += [(f"{k}.fastq.gz", i, *r) for i, r in enumerate(fastq.records(io.StringIO(text)))]
    for split in (500, 5000, 1 << 20):
        assert sorted(map(tuple, splits.read(spark, paths, block_gzip=True, split=split).collect())) == sorted(want)


def test_single_and_paired_runs_agree(spark):
    rows = [("s", i, f"r{i}", s, "I" * len(s)) for i, s in enumerate([REF_A, REF_B, REF_A[:60] + "TT" + REF_A[60:]])]
    schema = "file string, read_index long, read_id string, seq string, qual string"
    single = run_analysis(spark.createDataFrame(rows, schema), TWO_GENES)
    from guidelens.kernels.matching import reverse_complement as rc

    mate = "pair_id string, read_index long, read_id string, seq string, qual string"
    r1 = spark.createDataFrame([(f, i, f"{n}/1", s[:70], q[:70]) for f, i, n, s, q in rows], mate)
    r2 = spark.createDataFrame([(f, i, f"{n}/2", rc(s[-70:]), q[:70]) for f, i, n, s, q in rows], mate)
    reads, molecules = paired_reads(r1, r2, TWO_GENES)
    paired = run_analysis(reads, TWO_GENES)
    pick = lambda r: sorted((x.gene_ix, x.read_inner, x.read_count) for x in r.alleles.collect())
    assert pick(single) == pick(paired) and molecules.where("merged").count() == 3
    with pytest.raises(Exception, match="different numbers"):
        pairs.mate_records(r1, r2.where("read_index > 0")).collect()
    with pytest.raises(Exception, match="mates differ"):
        pairs.mate_records(r1, r2.withColumn("read_id", F.lit("other"))).collect()


def test_own_references_for_an_input(spark):
    config = AnalysisConfig((GENE_A,), by_input={"two": (GENE_B,)})
    reads = spark.createDataFrame([("one", 0, REF_A, None), ("two", 1, REF_B, None), ("two", 2, None, None)], "file string, read_index long, seq string, qual string")
    assert [r.outcome for r in assigned(reads, config, "file").orderBy("read_index").collect()] == ["assigned", "assigned", "filtered"]
    assert run_analysis(reads, config, "file").alleles.count() == 2
    assert assigned(reads.limit(0), config).count() == 0


def test_threshold_ties_keep_first_seen(spark):
    t = spark.createDataFrame([("f", 98, 5), ("f", 1, 9), ("f", 1, 7)], "file string, read_count long, first_seen long")
    assert sorted(r.first_seen for r in kept(t, ("file",), 1.0).collect()) == [5, 7, 9]
    assert kept(t, ("file",), 1.005).count() == 2 and kept(t, ("file",), 0).count() == 3


def test_restriction_site_over_the_origin(spark):
    d = spark.createDataFrame([(1, "TTCAAAAGAA"), (2, "GGTCTCAAAAAA"), (3, ""), (4, None)], "doc_id int, seq string")
    got = [tuple(r)[:6] for r in workspace.restriction_sites(d, circular=True).orderBy("doc_id").collect()]
    assert got == [(1, "EcoRI", 7, 3, 8, 2), (2, "BsaI", 0, 6, 7, 11)]
    assert workspace.restriction_sites(d).where("doc_id = 1").count() == 0


def test_orfs_on_both_strands(spark):
    seq = "CC" + "ATG" + "GCA" * 5 + "TAA" + "C"
    assert list(workspace.orfs(seq, 5)) == [(2, 23, 3, 1, "MAAAAA*")]
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert [(o[0], o[1], o[3]) for o in workspace.orfs(back, 5)] == [(1, 22, -1)]
    workspace.register_functions(spark)
    assert spark.sql(f"SELECT start FROM find_orfs('{seq}', 5)").first()[0] == 2


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(names.mate(lit("sample10.fastq"))) is None and one(names.sample_name(lit("sample10.fastq"))) == "Sample 10"
    assert one(names.pair_name(lit("a_R1.fq"), lit("b_R2.fq"))) == "A + B" and one(names.pair_name(lit(None), lit("b_R2.fq"))) == "B"
    assert one(names.merged_aliases(lit("a/b"), lit("b/c"))) == "a/b/c" and one(names.file_name(lit("x/y/z.gz"))) == "z.gz"
    assert one(names.normalized_barcode(lit("BC 01_a.b-c"))) == "bc01abc" and one(names.sheet_name(lit("a/b: c"))) == "a b c" and one(names.download_name(lit(" a|b.xlsx"), "x")) == "a b"
    sheets = spark.createDataFrame([(0, "x" * 40), (1, "X" * 31), (2, "/")], "n int, v string")
    assert [r.sheet for r in export.unique_sheets(sheets, "v", "n").orderBy("n").collect()] == ["x" * 31, "X" * 29 + " 2", "Barcode"]
    assert one(names.primary_failure(F.array(lit("no_coverage"), lit("no_anchor")))) == "no_anchor"


def test_mates_move_and_empty_pairs_go(spark):
    p = spark.createDataFrame([(1, "a_R1.fq", None), (2, None, "a_R2.fq")], "pair int, r1 string, r2 string")
    assert [(r.pair, r.r1, r.r2) for r in pairs.moved_mate(p, 2, "r2", 1, "r2").collect()] == [(1, "a_R1.fq", "a_R2.fq")]


def test_references(spark):
    bad = spark.createDataFrame([("g", "AC"), ("g", "AG"), ("h", "AC")], "gene string, sequence string")
    assert [r.gene for r in references.conflicting_genes(bad).collect()] == ["g"]
    w = spark.createDataFrame([(100, 64, True), (80, 20, True)], "length int, cut int, guide_found boolean")
    assert tuple(references.full_reference_window(w).first()) == (64, 60)
    with pytest.raises(Exception, match="isn't in its reference"):
        references.full_reference_window(w.withColumn("guide_found", F.lit(False))).collect()
    rows = spark.createDataFrame([(0, "x", REF_A, "t", GUIDE_A), (1, "y", REF_A.lower(), "t", GUIDE_A)], "ordinal long, gene string, sequence string, target string, guide string")
    (gene,) = references.genes_of(references.reference_payload(references.reference_rows(rows)))
    assert (gene.display, gene.sequence, len(gene.targets)) == ("x/y", REF_A, 1)


def test_merging(spark):
    t = spark.createDataFrame([("k", "g", "ac gt", "", "t1"), ("k", "g", None, "acg", "t2")], "kind string, gene string, sequence string, guide string, target_id string")
    assert [(r.gene_key, r.target_key) for r in merge.with_result_keys(t).orderBy("target_id").collect()] == [("k:sequence:ACGT", "t1"), ("k:name:g", "ACG")]
    m = spark.createDataFrame([("a", {1: 2}), ("a", {1: 3, 2: 1})], "k0 string, m map<int,int>")
    assert sorted((r.k, r.v) for r in merge.numeric_maps_added(m, "k0", "m").collect()) == [(1, 5), (2, 1)]
    n = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "g string, x long, y long")
    assert tuple(merge.merged_numbers(n, ("g",), ("x", "y")).first()) == ("a", 3, 5)


def test_suggestion(spark):
    reads = spark.createDataFrame([("f", i, s, None) for i, s in enumerate([REF_B, REF_B, REF_A])], "file string, read_index long, seq string, qual string")
    assert summary.suggestion(assigned(reads, TWO_GENES)).first().window == 1


