"""The corpus queries on the smallest tables, and the pipeline against a brute-force version of its decisions."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from guidelens.llm import queries
from guidelens.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    one, two = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(one.columns)
    one, two = (x[cols].sort_values(cols).reset_index(drop=True) for x in (one, two))
    pd.testing.assert_frame_equal(one, two, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op13_graph_neighbours"}))
def test_one_row_a_document(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == table(spark, SF, "documents").count()


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name.replace(" ", "-"))
        kept[name] = docs.toPandas()
    first = [k for k, _ in corpus_pipeline.STAGES]
    assert first == ["toxicity", "near-dedup", "secret scan", "mixing", "bpe"]
    assert all(list(kept[k].columns) == ["doc_id", "text", "lang", "source", "n_chars"] for k in first[:-1])
    texts = {i: set(zip(*(w[j:] for j in range(5)), strict=False)) if len(w := t.lower().split()) >= 5 else {tuple(w)} for i, t in zip(kept["toxicity"].doc_id, kept["toxicity"].text, strict=True)}
    alive = set(kept["near-dedup"].doc_id)
    for a in alive:  # no two documents that stay are near-duplicates, and those that went had one
        assert not any(a < b and texts[a] and 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b]) for b in alive)
    for a in set(texts) - alive:
        assert any(a != b and 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b]) for b in texts)
    assert set(kept["secret scan"].doc_id) == alive and not kept["secret scan"].text.str.contains(r'token = "[0-9a-f]{16}', regex=True).any()
    counts = kept["mixing"].doc_id.value_counts()
    assert counts.max() <= 2 and len(kept["bpe"]) == len(kept["mixing"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["bpe"])
