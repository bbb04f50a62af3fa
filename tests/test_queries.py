"""Every query with SQL gives DuckDB's rows on the same tables."""

import math
import os

import duckdb
import pytest

from visitloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, small, name):
    rows = plans.QUERIES[name](spark, small).collect()
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert os.path.isdir("/root/testdata/sf0.001")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
