"""Operators against plain Python, on rows that the driver's tables don't have."""

from collections import Counter

import pytest

from guidelens.operators import benchmark, homoeolog, references


def test_quality_histogram_of_mixed_qualities(spark):
    quals = ["", "!!I", "I#5\\.$^", None, "~~~~", "I" * 300 + "#"]
    want = Counter((ord(c) - 33) // 2 * 2 for q in quals for c in q or "")
    out = benchmark.quality_histogram(spark.createDataFrame([(q,) for q in quals], "qual string")).collect()
    assert {r.bucket: r.n for r in out} == want


def test_more_windows_than_can_be_side_by_side(spark):
    windows = spark.range(homoeolog.MAX_WINDOWS + 1).selectExpr("id AS ix", "'ACGT' AS seq")
    with pytest.raises(ValueError, match="side by side"):
        homoeolog.window_pairs(windows)


def test_override_of_an_id_goes_before_one_of_a_name(spark):
    inputs = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None)], "id string, name string")
    overrides = spark.createDataFrame([("1", "x"), ("a", "y")], "input string, config_key string")
    out = references.with_config(inputs, overrides).collect()
    assert {r.id: r.config_key for r in out} == {"1": "x", "2": "y", "3": "default"}


def test_undo_depth_and_deleted_items(spark):
    from guidelens.streaming.history import ACTIONS, after_log

    rows = [(1, i, "save", i) for i in range(30)] + [(1, 100 + i, "undo", None) for i in range(25)]
    rows += [(2, 0, "undo", None), (2, 1, "save", 7), (2, 2, "redo", None)]
    rows += [(3, 0, "save", 1), (3, 1, "save", 2), (3, 2, "delete", None), (3, 3, "undo", None)]
    rows += [(4, 0, "save", 1), (4, 1, "save", 2), (4, 2, "undo", None), (4, 3, "save", 3), (4, 4, "redo", None)]
    out = {r.id: (r.version, r.undo_steps, r.redo_steps) for r in after_log(spark.createDataFrame([(*r, None) for r in rows], ACTIONS)).collect()}
    assert out == {1: (9, 0, 20), 2: (7, 0, 0), 4: (3, 1, 0)}


def test_markers_without_groups_sequences_and_windows(spark):
    from guidelens.operators.homoeolog import markers

    ref = "ACGTTGCATGCCGATATCGGATCCATGCAAGCTTGACCTGAAC"
    refs = spark.createDataFrame([("g", 0, ref), ("g", 1, "T" * 44), ("g", 2, ""), (None, 3, ref), ("g", 4, None)], "homoeolog_group string, gene_ix int, sequence string")
    schema = "gene_ix int, target_id string, cut int, guide_from int, guide_to int, window_from int, window_to int, window_seq string, error string"
    windows = spark.createDataFrame([(0, "t", 20, 10, 30, 5, 40, ref[5:40], None), (1, "t", 3, 1, 5, 0, 9, "T" * 9, None), (3, "u", 20, 10, 30, 5, 40, ref[5:40], None)], schema)
    out = {(r.homoeolog_group, r.gene_ix, r.target_id): r for r in markers(refs, windows).collect()}
    assert set(out) == {("g", 0, "t"), ("g", 1, "t"), ("Homoeolog 4", 3, "u")}
    assert out["g", 1, "t"].is_anchor and out["g", 0, "t"].error.startswith("Reference alignment") and out["g", 0, "t"].guide_from is None
    own = out["Homoeolog 4", 3, "u"]
    assert (own.guide_from, own.guide_to, own.window_from, own.window_to, own.window_difference_bp, own.error) == (10, 30, 5, 40, 0, None)
    assert markers(refs.limit(0), windows).count() == 0 and markers(refs, windows.limit(0)).count() == 0


def test_segments_of_nulls_and_edges(spark):
    from pyspark.sql import functions as F

    from guidelens.functions.sequence import segments

    rows = spark.createDataFrame([("acXXgX", "123456"), ("XX", "12"), ("", ""), (None, None), ("AC", None)], "s string, q string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in rows.select(segments(F.col("s"), F.col("q"))).collect()]
    assert got == [[(0, 2, "AC", "12"), (4, 5, "G", "5")], [], [], None, [(0, 2, "AC", None)]]


def test_sql_functions_of_nulls(spark):
    from guidelens.functions.sql import register

    register(spark)
    r = spark.sql("SELECT edit_distance_within('ACGT', 'AGGT', 3) AS d, edit_distance_within(NULL, 'A', 1) AS n, edit_call('ACGTACGTACGTACGT', 'ACGTACGTACGTACGT').category AS c, homoeolog_similarity('', 'A') AS h, guide_cut_site(NULL, 'A') AS g, reference_identity('ACGT', 'ACGT') AS i").first()
    assert (r.d, r.n, r.c, r.h, r.i) == (1, None, "no_indel", 0.0, 100.0)
    assert r.g is None or r.g.cut is None


def test_accuracy_without_reads(spark):
    from guidelens.operators.assign import assigned
    from guidelens.operators.benchmark import accuracy
    from guidelens.queries.fixtures import TWO_GENES

    none = spark.createDataFrame([], "read_index bigint, seq string, qual string, true_gene string, true_target string")
    out = {(r.gene, r.target): (r.total, r.correct_rate, r.fail_quality) for r in accuracy(assigned(none, TWO_GENES), TWO_GENES).collect()}
    assert out == {("A", "t1"): (0, 0.0, 0), ("B", "t1"): (0, 0.0, 0), ("All", "All"): (0, 0.0, 0)}
