"""Every registered ledger query runs, and equals its SQL in DuckDB, on the smallest test tables."""

import os

import duckdb
import pytest

from quillstone.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(x):
    if x is None or x != x or str(x) in ("<NA>", "NaT"):
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = oracle.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 1


def test_every_query_but_a_few_has_sql():
    assert len(set(QUERIES) - set(SQL)) <= 3
