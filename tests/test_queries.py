"""Every registered query with SQL beside it equals that SQL; the others run and have rows."""

import duckdb
import pytest

from privlens.plans import catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(rows):
    out = []
    for r in rows:
        out.append(tuple(None if v is None else (round(float(v), 5) + 0.0 if not isinstance(v, (str, bool)) else v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = norm(df.select(cols).collect())
    result = db.execute(f"SELECT * FROM ({catalogue.SQL[name]})")
    assert sorted(d[0] for d in result.description) == cols
    want = norm(db.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_imports_without_the_training_data_operators(spark, sf, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    gone = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("privlens.llm")]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert not [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] and entry.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
