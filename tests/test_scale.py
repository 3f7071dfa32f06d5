"""Forms for very large inputs give what the plain forms give: seeds, running sums, chunks of genomes, batches of mates."""

import random

import pytest
from pyspark.sql import functions as F

from guidelens.config import AnalysisConfig, Gene, Target
from guidelens.functions.sequence import AMINO_ACIDS, IUPAC, IUPAC_COMPLEMENT
from guidelens.kernels import codons
from guidelens.kernels.cutsite import windows_of
from guidelens.kernels.locate import best_evidence, candidates
from guidelens.kernels.matching import reverse_complement
from guidelens.kernels.seeds import SeedIndex
from guidelens.operators import genomes, workspace
from guidelens.operators.alleles import kept, kept_and_ranked, ranked
from guidelens.operators.assign import Assigner
from guidelens.queries.fixtures import GENE_A, GENE_B, GUIDE_A, REF_A


def bases(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def panel(rng, n):
    """Genes, some of which share guides, lack theirs, are short, or hold other letters."""
    genes = [GENE_A, GENE_B]
    for k in range(n):
        ref = bases(rng, rng.choice([12, 60, 120, 300])) if k % 7 else bases(rng, 80, "ACGTN")
        guide = ref[20:40] or bases(rng, 20)
        if k % 5 == 1:
            ref, guide = REF_A[:50] + bases(rng, 10) + REF_A[50:], GUIDE_A
        if k % 11 == 3:
            guide = reverse_complement(guide)
        genes.append(Gene(f"g{k}", ref, (Target("t", guide), Target("u", bases(rng, 20)))[: 1 + k % 2]))
    return tuple(genes)


def reads_of(rng, genes, n):
    for _ in range(n):
        ref = rng.choice(genes).sequence
        a = rng.randrange(0, max(1, len(ref) // 2))
        read = ref[a : a + rng.randrange(20, 200)]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, max(1, len(read)))
            read = rng.choice([read[:at] + read[at + rng.randrange(1, 6) :], read[:at] + bases(rng, 3) + read[at:], read[:at] + "X" * rng.randrange(1, 4) + read[at:], read[:at] + rng.choice("ACGTN") + read[at + 1 :]])
        yield rng.choice([read, reverse_complement(read), read + "XX" + reverse_complement(read)[:60], bases(rng, 80), ""])


class Everywhere:
    """In place of an index: every window."""

    def __init__(self, windows):
        self.numbers = [w.number for w in windows]

    def __call__(self, _):
        return self.numbers


@pytest.mark.parametrize("by_target", [False, True])
def test_seeds_find_what_all_windows_find(by_target):
    rng = random.Random(7)
    config = AnalysisConfig(panel(rng, 40), phred=20.0)
    one, all_ = Assigner(config.genes, config, by_target), Assigner(config.genes, config, by_target)
    all_.seeds = Everywhere(all_.windows)
    outcomes = set()
    for read in reads_of(rng, config.genes, 250):
        qual = "".join(rng.choice("#5I") for _ in read)
        got = one(read, qual)
        assert got == all_(read, qual)
        outcomes.add(got[0])
    assert outcomes == {"assigned", "ambiguous", "filtered"}


def test_a_read_meets_few_windows_of_a_large_panel():
    rng = random.Random(8)
    windows = windows_of(panel(rng, 2000))
    index = SeedIndex([w for w in windows if not w.ref.strip("ACGT")])
    read = windows[50].ref
    met = index([read])
    assert 50 in met and len(met) < 20
    for n in rng.sample(range(len(windows)), 200):
        if n not in met and not windows[n].ref.strip("ACGT"):
            found, reasons = candidates(read, windows[n])
            assert best_evidence(read, found, [True] * len(found), reasons) == "no_alignment"


def plain_orfs(seq, least):
    top = seq.upper().replace("U", "T")
    amino = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    for strand, dna in ((1, top), (-1, top[::-1].translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT)))):
        for frame in range(3):
            begin = None
            for i in range(frame, len(dna) - 2, 3):
                if begin is None and dna[i : i + 3] == "ATG":
                    begin = i
                elif begin is not None and amino.get(dna[i : i + 3]) == "*":
                    if i + 3 - begin >= 3 * least:
                        clean = "".join(c for c in dna[begin : i + 3] if c in "ACGT")
                        span = (begin, i + 3) if strand > 0 else (len(dna) - i - 3, len(dna) - begin)
                        yield (*span, strand * (frame + 1), strand, "".join(amino[clean[j : j + 3]] for j in range(0, len(clean) - 2, 3)))
                    begin = None


def dna_texts():
    rng = random.Random(9)
    yield from ("", "A", "AT", "ATG", "ATGTAA", "ATGAAA" * 5)
    for n in (10, 100, 500, 2000):
        yield bases(rng, n)
        yield bases(rng, n, "ACGTacgtUNRYx")
        yield bases(rng, n, "ATG")
    yield "CC" + "ATG" + "GCA" * 400 + "TAA" + bases(rng, 50)
    yield codons.reverse_strand("CC" + "ATG" + "GCN" * 400 + "TAA" + bases(rng, 50))


def test_orfs_as_read_codon_by_codon():
    for seq in dna_texts():
        for least in (1, 5, 30):
            assert sorted(codons.orfs(seq, least)) == sorted(plain_orfs(seq, least))


@pytest.mark.parametrize("size", [1, 7, 64, 500, 10_000])
def test_chunks_of_sequences(spark, size):
    texts = [t for t in dna_texts() if size > 1 or len(t) <= 300]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, seq string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    least = 5
    assert rows(genomes.chunked_orfs(docs, least, size=size)) == rows(workspace.find_orfs(docs, least))
    for circular in (False, True):
        assert rows(genomes.chunked_sites(docs, circular, size=size)) == rows(workspace.restriction_sites(docs, circular))
    assert rows(genomes.chunked_motifs(docs, "ARY", size=size)) == rows(workspace.motif_search(docs, "ARY"))


def test_a_long_sequence_in_many_tasks(spark):
    """Two million bases: sites, frames (one of them over many chunks) and strips."""
    rng = random.Random(10)
    seq = bases(rng, 1_000_000) + "ATG" + "GCA" * 100_000 + "TAA" + bases(rng, 700_000)
    docs = spark.createDataFrame([(1, seq)], "doc_id long, seq string")
    got = {tuple(r)[1:] for r in genomes.chunked_orfs(docs, 60, size=1 << 16).collect()}
    assert got == set(codons.orfs(seq, 60)) and max(b - a for a, b, *_ in got) > 300_000
    assert genomes.chunked_sites(docs, size=1 << 16).where("enzyme = 'EcoRI'").count() == seq.count("GAATTC")
    strips = workspace.row_strips(docs).agg(F.count("*"), F.sum(F.length("bases")), F.max("end"), F.count_if(F.col("complement") == F.translate("bases", "ACGT", "TGCA"))).first()
    assert tuple(strips) == (-(-len(seq) // 60), len(seq), len(seq), -(-len(seq) // 60))


def test_strips(spark):
    docs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGT"), (3, ""), (4, None)], "doc_id long, seq string")
    got = sorted(map(tuple, workspace.row_strips(docs, 4).collect()))
    assert got == [(1, 0, 0, 4, "ACGT", "TGCA"), (1, 1, 4, 8, "ACGT", "TGCA"), (1, 2, 8, 10, "AC", "TG"), (2, 0, 0, 4, "ACGT", "TGCA")]


def test_running_sums_over_blocks(spark, monkeypatch):
    from guidelens.operators import running

    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, 3, 50]), i) for i in range(600)] + [("c", 5, None), ("c", 5, 3)]
    table = spark.createDataFrame(rows, "file string, read_count long, first_seen long")
    for block in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(running.with_running, "__defaults__", (block,))
        got = {(r.file, r.read_count, r.first_seen): r.group_rank for r in ranked(table, ("file",)).collect()}
        share = {(r.file, r.read_count, r.first_seen): r.group_rank for r in kept_and_ranked(table, ("file",), 0.4).collect()}
        assert {tuple(r) for r in kept(table, ("file",), 0.4).collect()} == set(share)
        for name in ("a", "b", "c", None):
            mine = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[1], r[2] is not None, r[2] or 0))
            total = 0
            for rank, r in enumerate(mine, 1):
                total += r[1]
                assert got[r] == rank and (r in share) == (r[1] / total * 100 >= 0.4) and share.get(r, rank) == rank
    assert 0 < len(share) < len(rows)


def test_ten_million_alleles_of_one_target_spread(spark):
    """No task gets the whole target: the largest partition of the second level is bounded by BLOCK rows of one count."""
    table = spark.range(300_000).select(F.lit("f").alias("file"), F.lit(1).cast("long").alias("read_count"), F.col("id").alias("first_seen"))
    from guidelens.operators.running import with_running

    out = with_running(table, ("file",), "read_count", "first_seen", block=1 << 12)
    assert out.where("_rank <> first_seen + 1 or _running <> _rank").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan


def plain_overlap(a, b, least, identity):
    for offset in [*range(len(a) - least + 1), *range(-1, least - len(b) - 1, -1)]:
        p, q = a[max(0, offset) :], b[max(0, -offset) :]
        n = min(len(p), len(q))
        both = [(x, y) for x, y in zip(p, q, strict=False) if x != "X" and y != "X"]
        first = [(x, y) for x, y in list(zip(p, q, strict=False))[:50] if x != "X" and y != "X"]
        if n >= least and len(both) >= least and sum(x != y for x, y in first) <= min(5, int(len(first) * (1 - identity) + 1e-9)):
            return offset, n, len(both), sum(x != y for x, y in both)
    return None


def plain_merge(a, qa, b, qb, window, least, identity):
    found = plain_overlap(a, b, least, identity)
    if not found:
        return a + "X" * max(1, window) + b, qa + [0] * max(1, window) + qb, False, 0, 0.0
    o, n, compared, wrong = found
    i, j = max(0, o), max(0, -o)
    at = lambda q, k: q[k] if k < len(q) else 0
    seq = "".join(a[i + k] if a[i + k] == b[j + k] or at(qa, i + k) >= at(qb, j + k) else b[j + k] for k in range(n))
    tail, tail_q = (b[j + n :], qb[j + n :]) if o >= 0 else ("", [])
    return a[:i] + seq + tail, qa[:i] + [max(at(qa, i + k), at(qb, j + k)) for k in range(n)] + tail_q, True, n, (compared - wrong) / compared


@pytest.mark.parametrize("least,identity", [(10, 0.8), (1, 0.95), (60, 0.5)])
def test_overlaps_of_a_batch(least, identity):
    import numpy as np

    from guidelens.kernels.overlap import merged_pairs, overlaps

    rng = random.Random(12)
    pairs = [("", ""), ("A" * 20, ""), ("ACGT" * 30, "ACGT" * 30), ("X" * 60 + "ACGTTGCA" * 20, "ACGTTGCA" * 20)]
    for _ in range(600):
        ref = bases(rng, rng.randrange(15, 200), rng.choice(["ACGT", "ACGTN", "AC", "ACGTXR"]))
        a, b = ref[: rng.randrange(5, 200)], ref[rng.randrange(0, max(1, len(ref) - 12)) :]
        if rng.random() < 0.3:
            a, b = b, a
        spoil = lambda s: "".join(rng.choice("ACGTX") if rng.random() < 0.04 else c for c in s)
        pairs.append((spoil(a), spoil(b)))
    got = overlaps([a for a, _ in pairs], [b for _, b in pairs], least, identity)
    want = [plain_overlap(a, b, least, identity) for a, b in pairs]
    assert got == want and 100 < sum(w is not None for w in want) and (None in want) and any(w and w[0] < 0 for w in want) and any(w and w[3] for w in want)
    quals = [([rng.randrange(0, 40) for _ in range(rng.choice([len(a), len(a) // 2]))], [rng.randrange(0, 40) for _ in b]) for a, b in pairs]
    merged = merged_pairs([(a, np.array(x, np.int64), b, np.array(y, np.int64)) for (a, b), (x, y) in zip(pairs, quals, strict=True)], 7, least, identity)
    for (a, b), (x, y), (seq, qual, *rest) in zip(pairs, quals, merged, strict=True):
        assert (seq, qual.tolist(), *rest) == plain_merge(a, x, b, y, 7, least, identity)


def test_reads_are_viewed_once(spark):
    """Equal reads of a batch are one call, and what is laid on shared columns isn't aligned again for each aggregate."""
    from guidelens.operators import columns

    same = spark.createDataFrame([("a",)] * 9 + [("b",)] * 9, "seq string").coalesce(1)
    drawn = columns._with(same, "drawn string", ("seq",), lambda seq: (str(random.random()),))
    assert drawn.distinct().count() == 2
    tokens = [[("insert", "T"), ("equal", "ACGT")], [("equal", "AC"), ("insert", "GG"), ("delete", "--")], [("equal", "ACGT"), ("insert", "C")], None]
    rows = [("p", i, t is not None, "x" * i, None if t is None else [{"type": k, "val": v} for k, v in t]) for i, t in enumerate(tokens)]
    views = spark.createDataFrame(rows, f"page string, i int, aligned boolean, pre string, tokens {columns.TOKENS}")
    out = columns.pileup(views.mapInArrow(lambda batches: batches, views.schema), ["page"])
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert {r.i: (r.lead, r.laid) for r in out.collect()} == {0: ("  ", "TAC--GT-"), 1: (" x", "-ACGG---"), 2: ("xx", "-AC--GTC"), 3: (None, None)}


def test_chunked_frames_are_searched_once(spark):
    """One pass cuts, one searches; what runs over chunks is relational, and the rows are those of whole sequences."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(k, bases(rng, n)) for k, n in enumerate((0, 2, 99, 100, 101, 700, 5000))] + [(90, None), (91, "ATG" * 300), (92, "ATG" + "GCA" * 300 + "TAA"), (93, "CATTTA" * 100)], "doc_id long, seq string")
    for size in (90, 100):
        out = genomes.chunked_orfs(docs, 5, size=size)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "InPandas" not in plan
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, workspace.find_orfs(docs, 5).collect()))


def test_guide_with_fewest_mismatches_by_trying_every_place():
    from guidelens.kernels.cutsite import _fewest

    rng = random.Random(3)
    for _ in range(300):
        ref, query = bases(rng, rng.choice([3, 5, 9, 40]), "CG" if rng.random() < 0.5 else "ACGTN"), bases(rng, rng.choice([1, 2, 3]), "CGT")
        n, tried = len(query), []
        for at in range(len(ref) - n + 1):
            after, before = ref[at + n : at + n + 3], ref[at - 3 : at] if at >= 3 else ""
            for back, text, has in ((False, query, after[1:] == "GG"), (True, reverse_complement(query), before[:2] == "CC")):
                tried.append((sum(a != b for a, b in zip(ref[at : at + n], text, strict=True)), not has, at, back))
        m, _, at, back = min(tried)
        assert _fewest(ref, query) == (m, at, back)


def test_equal_mates_and_reads_are_one_call(spark, monkeypatch):
    """However often a pair or a read repeats in a batch, it is merged, judged and called once."""
    from guidelens.operators import assign, pairs
    from guidelens.queries.fixtures import TWO_GENES

    def passes(frame, make):
        """The rows and batches of an operator's own function, run here over a batch of rows."""
        taken = {}
        monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: taken.update(run=run))
        make(frame)
        monkeypatch.undo()
        return lambda table: next(iter(taken["run"](iter(table.combine_chunks().to_batches()))))

    r2 = reverse_complement(REF_A[30:])
    mates = spark.createDataFrame([(k, REF_A[:70], "I" * 70, r2, "I" * 70) for k in range(50)] + [(50, REF_A[:70], "+" * 70, r2, "+" * 70)], "k long, r1_seq string, r1_qual string, r2_seq string, r2_qual string")
    merge, table, calls = passes(mates, lambda f: pairs.merged(f, TWO_GENES)), mates.toArrow(), []
    whole = pairs.merged_pairs
    monkeypatch.setattr(pairs, "merged_pairs", lambda part, *rest: calls.append(len(part)) or whole(part, *rest))
    out = merge(table)
    assert sum(calls) == 2 and out.column("seq").to_pylist() == [REF_A] * 51 and out.column("k").to_pylist() == list(range(51))
    monkeypatch.undo()
    table = mates.select("k", F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual"))
    call, calls = passes(table, lambda f: assign.assigned(f, TWO_GENES)), []
    one = assign.Assigner.__call__
    monkeypatch.setattr(assign.Assigner, "__call__", lambda self, *read: calls.append(read) or one(self, *read))
    assert call(table.toArrow()).num_rows == 51 and len(calls) == 2
    monkeypatch.undo()
    slim = assign.assigned(table, TWO_GENES, with_hits=False)
    assert "hits" not in slim.columns and slim.orderBy("k").collect() == assign.assigned(table, TWO_GENES).drop("hits").orderBy("k").collect()


def test_a_report_makes_its_rows_once(spark):
    """The reads behind a report's counts aren't gone through again for each part of its sheets."""
    from guidelens.operators import workbooks

    flow = spark.createDataFrame([("f", 3, 2, 2, 1)], "scope string, raw long, phred_passed long, usable long, assigned long")
    flow = flow.mapInArrow(lambda batches: batches, flow.schema)
    targets = spark.createDataFrame([("f", "A", "Normal", "t1", 2, 1, 0.0, 0.0, 100.0, 0.0)], "scope string, gene string, source string, target_id string, total_reads long, aligned_reads long, out_of_frame_pct double, in_frame_pct double, no_indel_pct double, substitution_pct double")
    out = workbooks.report_sheets({"Phred Threshold": 20.0}, flow, targets)
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and out.where("not hidden").count() > 8
