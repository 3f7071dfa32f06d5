"""Every query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from guidelens.queries.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def compared(one: pd.DataFrame, two: pd.DataFrame) -> None:
    assert sorted(one.columns) == sorted(two.columns)
    cols = sorted(one.columns)
    one, two = (x[cols].sort_values(cols).reset_index(drop=True) for x in (one, two))
    pd.testing.assert_frame_equal(one, two, check_dtype=False, rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    compared(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_reads_against_one_read_at_a_time(spark):
    from collections import Counter

    from guidelens.operators.assign import Assigner
    from guidelens.queries.fixtures import TWINS, reads
    from guidelens.queries.results import _ONE

    rows = reads(spark, SF).select("read_index", "file", "true_gene", "seq", "qual").collect()
    one, twins = Assigner(_ONE.genes, _ONE), Assigner(TWINS.genes, TWINS)
    reasons, keys, want = Counter(), Counter(), {}
    for r in rows:
        hit = one(r.seq, r.qual)[5][0]
        want[r.read_index] = hit["reason"], hit["read_window"]
        if hit["reason"] != "ok":
            reasons[r.file, hit["reason"]] += 1
        outcome, *_, hits = twins(r.seq, r.qual)
        ok = [h for h in hits if h["reason"] == "ok"]
        if outcome == "ambiguous" and ok:
            best = min(ok, key=lambda h: (-h["whole_score"], h["window"]))
            keys[r.file, best["gene_ix"], best["read_window"].upper()] += 1
    from guidelens.operators.alleles import target_hits
    from guidelens.operators.assign import assigned

    got = target_hits(assigned(reads(spark, SF), _ONE)).collect()
    assert {r.read_index: (r.reason, r.read_window) for r in got} == want and len(got) == len(rows)
    assert {(r.file, r.reason): r.n for r in QUERIES["failure_reasons"](spark, SF).collect()} == reasons
    clusters = {(r.file, r.key, r.cluster, r.rescued) for r in QUERIES["rescue_clusters"](spark, SF).collect()}
    assert clusters == {(f, k, n, n >= TWINS.rescue_reads) for (f, _, k), n in keys.items()}
    union = Counter({(r.gene, r.kind): r.n for r in QUERIES["ambiguous_union"](spark, SF).collect()})
    saved = Counter()
    for (_, g, _), n in keys.items():
        if n >= TWINS.rescue_reads:
            saved["A" if g == 0 else "A2"] += n
    assert sum(n for (_, kind), n in union.items() if kind == "rescued") == sum(saved.values())


def test_coedit_of_any_number_of_copies(spark):
    from guidelens.operators import homoeolog

    rows = [("one", 1, 30.0), ("two", 1, 50.0), ("two", 2, 20.0), ("three", 1, 50.0), ("three", 2, 50.0), ("three", 3, 20.0)]
    out = homoeolog.coedit_independence(spark.createDataFrame(rows, "grp string, copy int, rate double"), "grp", "copy").collect()
    got = {r.grp: (r.p_both, r.p_none, r.p_single) for r in out}
    assert got["one"] == pytest.approx((30, 70, 0)) and got["two"] == pytest.approx((10, 40, 50)) and got["three"] == pytest.approx((5, 20, 75))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "read_inner" in out.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
