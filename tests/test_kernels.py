"""Kernels on examples made here: cut sites, windows, usability, scores, calls, overlaps, comparisons."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from guidelens.config import AnalysisConfig, Gene, Target
from guidelens.kernels import cutsite, locate, matching, mutate, overlap, pairwise, score
from guidelens.operators.assign import Assigner
from guidelens.queries.fixtures import GUIDE_A, GUIDE_B, REF_A, REF_B, TWO_GENES

DNA = st.text("ACGT", min_size=1, max_size=40)
WINDOW = cutsite.window_of(Gene("A", REF_A, (Target("t", GUIDE_A),)), Target("t", GUIDE_A))


def evidence(seq, qual=None, phred=20.0, window=WINDOW):
    found, why = locate.candidates(seq, window)
    ok = [qual is None or sum(qual[c.qual_start : c.qual_end]) / (c.qual_end - c.qual_start) >= phred for c in found]
    return locate.best_evidence(seq, found, ok, why)


def test_cut_site_forward_reverse_and_missing():
    site = cutsite.find_cut_site(REF_A, GUIDE_A)
    assert (site.strand, site.start, site.cut, site.pam) == ("forward", 47, 64, "AGG")
    back = cutsite.find_cut_site(matching.reverse_complement(REF_A), GUIDE_A)
    assert (back.strand, back.pam, back.cut) == ("reverse", "CCT", 100 - 64)
    assert cutsite.find_cut_site(REF_A, "A" * 20).cut == 50 and cutsite.find_cut_site(REF_A, "").strand == "unknown"
    with_motif = REF_A[47:70]
    assert cutsite.find_cut_site("T" * 30 + with_motif + "TTTT", with_motif).cut == 30 + 23 - 6


def test_window():
    assert (len(WINDOW.ref), WINDOW.cut, WINDOW.ref) == (81, 45, REF_A[19:])
    assert cutsite.window_bounds(100, 64, 90, 10, 5) == (54, 69)


def test_anchor_errors_four_pass_five_fail():
    def spoiled(n):
        left = list(REF_A[19:34])
        for i in range(n):
            left[2 * i + 1] = {"A": "C", "C": "G", "G": "T", "T": "A"}[left[2 * i + 1]]
        return "".join(left) + REF_A[34:]

    assert isinstance(evidence(spoiled(4)), locate.Evidence)
    assert not isinstance(evidence(spoiled(5)), locate.Evidence)


def test_low_quality_and_no_quality():
    assert evidence(REF_A, [10] * 100) == "quality"
    assert isinstance(evidence(REF_A, None), locate.Evidence)
    assert evidence("ACGT" * 30) == "no_alignment"


def test_truncation_leaves_x():
    e = evidence(REF_A[27:])
    assert (e.left_x, e.right_x, e.read_window) == (8, 0, "X" * 8 + REF_A[27:])
    e = evidence(REF_A[:92])
    assert (e.left_x, e.right_x) == (0, 8)


def test_large_deletion_between_two_observed_flanks():
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(466))
    ref = ref[:210] + "GACCTTGACATCGGATCATA" + "TGG" + ref[233:]
    window = cutsite.window_of(Gene("g", ref, ()), Target("t", "GACCTTGACATCGGATCATA", 440))
    for size in (200, 300, 400):
        for shift in (-5, 0, 5):
            start = 227 - size // 2 + shift
            read = ref[:start] + ref[start + size :]
            e = evidence(read, window=window)
            c = mutate.call(window.ref, e.read_window, e.left_x, e.right_x)
            assert c.net_indel == -size and [t[0] for t in c.tokens].count("delete") == 1


def test_calls():
    assert mutate.call(REF_A, REF_A).tokens == [("equal", REF_A)]
    sub = REF_A[:50] + "A" + REF_A[51:]
    assert (mutate.call(REF_A, sub).category, mutate.call(REF_A, sub).has_sub) == ("no_indel", True)
    assert mutate.call(REF_A, REF_A[:60] + REF_A[63:]).category == "in_frame"
    assert mutate.call(REF_A, REF_A[:60] + "TTAC" + REF_A[60:]).net_indel == 4
    c = mutate.call(WINDOW.ref, "X" * 8 + WINDOW.ref[8:], 8, 0)
    assert c.category == "no_indel" and c.tokens[0] == ("unobserved", "X" * 8) and mutate.materialized(WINDOW.ref, c.tokens) == WINDOW.ref


def test_mates_with_a_gap_are_no_deletion():
    c = mutate.call(REF_A, REF_A[:40] + "X" * 90 + REF_A[60:])
    assert (c.category, c.net_indel) == ("no_indel", 0) and ("unobserved", "X" * 20) in c.tokens


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_tokens_rebuild_the_read_and_consume_the_reference(ref, read):
    tokens = mutate.align(ref, read)
    assert "".join(b for k, b in tokens if k != "delete") == read
    assert sum(len(b) for k, b in tokens if k != "insert") == len(ref)


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_comparison_is_symmetric_and_least(a, b):
    one, ops = pairwise.compare_references(a, b)
    two, _ = pairwise.compare_references(b, a)
    assert one == two
    wrong = sum(max(i2 - i1, j2 - j1) for t, i1, i2, j1, j2 in ops if t != "equal")
    assert wrong == pairwise.edit_matrix(a, b)[-1, -1] == matching.within_edits(a, b, 100)


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_optimal_opcodes_rebuild(a, b):
    ops = score.optimal_opcodes(a, b)
    assert sum(i2 - i1 for _, i1, i2, _, _ in ops) == len(a) and sum(j2 - j1 for *_, j1, j2 in ops) == len(b)


def test_scores():
    assert score.window_score(REF_A, REF_A, 64) == 1.0
    assert score.window_score("X" * 10 + REF_A[10:], REF_A, 64) == 1.0
    deletion = REF_A[:60] + REF_A[66:]
    assert score.window_score(deletion, REF_A, 64) < 1 and score.window_score(deletion, REF_A, 64, 0.0, 8) == 1.0
    assert score.weight(0, 45, 2.0) == 1.0 and score.weight(45, 45, 2.0) == 3.0


@pytest.mark.parametrize("gene,ref", [("A", REF_A), ("B", REF_B)])
def test_assignment_same_for_either_strand_and_monotone_in_margin(gene, ref):
    edits = [ref, ref[:60] + ref[65:], ref[:58] + "TTG" + ref[58:]]
    for read in edits:
        outcomes = []
        for margin in (0.0, 0.02, 0.1, 1.0):
            a = Assigner(TWO_GENES.genes, AnalysisConfig(TWO_GENES.genes, margin=margin))
            one, back = a(read, None), a(matching.reverse_complement(read), None)
            assert one[:2] == back[:2]
            outcomes.append(one[0] == "assigned")
        assert outcomes == sorted(outcomes, reverse=True)
        assert outcomes[0]


def test_twin_genes_are_ambiguous():
    twins = (Gene("A", REF_A, (Target("t", GUIDE_A),)), Gene("C", REF_A, (Target("t", GUIDE_A),)))
    assert Assigner(twins, AnalysisConfig(twins))(REF_A, None)[0] == "ambiguous"
    assert Assigner(twins, AnalysisConfig(twins))("ACGT" * 20, None)[0] == "filtered"
    assert Assigner(twins, AnalysisConfig(twins))(None, None)[0] == "filtered"


def test_seedless_homoeolog_is_recovered_beside_a_located_one():
    # the second gene has the guide of the first, but a read of the first has an edit in it: only anchors locate it
    other = REF_A[:75] + "G" + REF_A[76:]
    genes = (Gene("A", REF_A, (Target("t", GUIDE_A),)), Gene("D", other, (Target("t", GUIDE_A),)))
    read = REF_A[:60] + REF_A[63:]
    outcome, gene, top1, top2, *_ = Assigner(genes, AnalysisConfig(genes, margin=0.001))(read, None)
    assert (outcome, gene) == ("assigned", 0) and top2 is not None and top1 > top2


def test_overlap():
    r2 = REF_A[30:]
    m = overlap.merge_pair(REF_A[:70], [30] * 70, r2, [35] * 70, 90)
    assert (m.seq, m.merged, m.overlap, m.identity) == (REF_A, True, 40, 1.0)
    gap = overlap.merge_pair(REF_A[:40], [30] * 40, REF_A[60:], [30] * 40, 90)
    assert not gap.merged and gap.seq == REF_A[:40] + "X" * 90 + REF_A[60:] and len(gap.qual) == len(gap.seq)
    spoiled = "T" + r2[1:] if r2[0] != "T" else "A" + r2[1:]
    assert overlap.merge_pair(REF_A[:70], [30] * 70, spoiled, [10] * 70, 90).seq == REF_A


def test_homoeolog_site_and_projection():
    m = cutsite.find_homoeolog_site(REF_A, GUIDE_B)
    assert (m.matched, m.exact, m.mismatches, m.start, m.identity) == (True, False, 1, 47, 95.0)
    assert not cutsite.find_homoeolog_site("A" * 50, GUIDE_B).matched
    assert pairwise.project_position(REF_A, REF_B, 47) == 47 and pairwise.project_position(REF_A, "", 1) is None
    assert pairwise.homoeolog_similarity(REF_A, REF_A) == 100.0 and pairwise.homoeolog_similarity("", REF_A) == 0.0


def test_pairwise():
    a, b, s, i = pairwise.align_pairwise("GATTACA", "GATACA")
    assert (a.replace("-", ""), b.replace("-", ""), s) == ("GATTACA", "GATACA", 4) and i == pytest.approx(600 / 7)
    assert pairwise.align_pairwise("TTTGATTACATTT", "CCGATTACACC", "local")[:3] == ("GATTACA", "GATTACA", 7)


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        AnalysisConfig((Gene("A", "", (Target("t", "ACGT"),)),))
    with pytest.raises(ValueError):
        AnalysisConfig((Gene("A", "ACGT", ()),))


def test_single_targets_compete():
    a = Assigner(TWO_GENES.genes, TWO_GENES, by_target=True)
    outcome, gene, *_, hits = a(REF_B, None)
    assert (outcome, gene, len(hits)) == ("assigned", 1, 1)
    twins = (Gene("A", REF_A, (Target("t", GUIDE_A), Target("u", GUIDE_A))),)
    assert Assigner(twins, AnalysisConfig(twins), by_target=True)(REF_A, None)[0] == "ambiguous"
    assert Assigner(twins, AnalysisConfig(twins))(REF_A, None)[0] == "assigned"


def test_window_grid():
    cells = mutate.window_grid([("equal", "AC"), ("insert", "GG"), ("delete", "--"), ("substitute", "T")], 7)
    assert cells == [("A", "equal", ""), ("C", "equal", "GG"), ("-", "delete", ""), ("-", "delete", ""), ("T", "substitute", ""), ("X", "unobserved", ""), ("X", "unobserved", "")]
    assert mutate.window_grid([("insert", "G"), ("equal", "AC")], 3) == [("X", "unobserved", "G"), ("A", "equal", ""), ("C", "equal", "")]
    assert pairwise.difference_bp(REF_A, REF_B) == 6


def homologs():
    """Two genes with one guide; the second has other bases on both sides, three of them missing on the left."""
    left, guide, right = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(60)), "GATTACAGCTTCGAACCTGA", "AGG" + "".join("CTAG"[(i * 7 + i // 5) % 4] for i in range(57))
    other = left[:20] + left[23:40] + "T" + left[41:] + guide + right[:30] + "A" + right[31:]
    return left + guide + right, other, guide


def test_borders_follow_what_is_missing():
    one, other, guide = homologs()
    place = score.borders(one, other, guide)
    assert place[:, 0].tolist() == [0, 0] and place[:, len(one)].tolist() == [len(other)] * 2
    assert all(one[i] == other[place[0, i]] for i in range(60, 80)) and place[0, 60] == 57
    assert place[0, 21] == -1  # inside what is missing
    assert score.borders(one, other.replace(guide, guide[::-1]), guide) is None and score.borders(one + guide, other, guide) is None


def test_a_read_is_judged_alike_on_both_strands_and_at_any_margin():
    from guidelens.config import AnalysisConfig, Gene, Target
    from guidelens.kernels.matching import reverse_complement
    from guidelens.operators.assign import Assigner

    one, other, guide = homologs()
    genes = (Gene("one", one, (Target("t", guide),)), Gene("two", other, (Target("t", guide),)))
    reads = [one, other, one[:76] + one[80:], other[:70] + other[75:], one[:77] + "TT" + one[77:], one[8:132], other[:74] + "C" + other[75:]]
    for by_target in (False, True):
        for read in reads:
            tops, genes_won = set(), set()
            for margin in (0.0, 0.005, 0.02, 0.1):
                judge = Assigner(genes, AnalysisConfig(genes, phred=20, margin=margin), by_target)
                ahead, back = judge(read, None), judge(reverse_complement(read), None)
                assert ahead[:2] == back[:2] and ahead[2] == back[2]
                tops.add(ahead[2])
                genes_won |= {ahead[1]} - {None}
            assert len(tops) == 1 and len(genes_won) <= 1
    judge = Assigner(genes, AnalysisConfig(genes, phred=20, margin=0.01))
    assert judge(one, None)[:2] == ("assigned", 0) and judge(other, None)[1] != 0


def test_votes_of_observations():
    from guidelens.config import Gene, Target
    from guidelens.kernels.cutsite import windows_of
    from guidelens.kernels.locate import Evidence

    one, other, guide = homologs()
    same = one[:50] + ("C" if one[50] == "A" else "A") + one[51:]
    panel = score.Panel(windows_of((Gene("one", one, (Target("t", guide),)), Gene("two", same, (Target("t", guide),)))), 0.0, 0)
    a, b = panel.windows.values()
    seen = lambda text: Evidence(text, text, 0, 0, False)
    apart = panel.scores({a.number: seen(a.ref), b.number: seen(b.ref)})
    assert len(set(apart.values())) == 1  # each crop is its own window's: a tie
    agreed = panel.scores({a.number: seen(a.ref), b.number: seen(a.ref)})
    assert agreed[a.number] == 1.0 > agreed[b.number]
    lent = panel.completed({a.number: seen(a.ref), b.number: "no_alignment"})
    assert lent[b.number].recovered and lent[b.number].scored_window == a.ref
    assert panel.completed({a.number: "no_anchor", b.number: "no_alignment"}) == {}
