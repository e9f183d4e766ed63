"""Every query of the engine against its SQL in DuckDB, at the smallest scale."""

from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from quillspan.plans import queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline_e2e"])
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in queries.ORACLES:
        assert rows
        return
    q = con.execute(queries.ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    want = q.fetchall()
    assert Counter(tuple(r[c] for c in cols) for r in rows) == Counter(tuple(r[names.index(c)] for c in cols) for r in want)


def test_whole_texts_are_normalized(spark):
    """By brute force on every text, past the first 40 characters."""
    from quillspan.functions.text import plain_name

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.norm for r in queries.QUERIES["name_normalize_texts"](spark, SF).collect()}
    assert got == {i: plain_name(t) for i, t in texts.items()}
    assert max(map(len, got.values())) > 1000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
