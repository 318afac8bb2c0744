"""Every named query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(rows):
    plain = lambda x: round(float(x), 4) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = norm(df.select(*columns).collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == norm(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["serving_copies", "file_sources"])
def test_copies_are_dealt_by_chunk_to_more_tasks_for_more_lines(spark, name, monkeypatch):
    monkeypatch.setattr("tidemark.relations.LINES_A_TASK", 500)
    df = QUERIES[name](spark, DIR)
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning(chunk_id" in x and f", {-(-lines // 500)})" in x]
    assert dealt and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "digest" in x]
