"""Every registered query against its DuckDB twin, over the smallest tables."""

import math
import os

import duckdb
import pytest

from strandline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return v if isinstance(v, (bool, str)) else str(v)


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1.0, abs(x)))


def compare(got, con, sql):
    rel = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    mine = [[plain(r[n]) for n in names] for r in got.collect()]
    at = [rel.columns.index(n) for n in names]
    want = [[plain(r[k]) for k in at] for r in rel.fetchall()]
    key = lambda r: [(x is None, str(type(x)), round(x, 6) if isinstance(x, float) else "" if x is None else x) for x in r]
    assert len(mine) == len(want)
    assert all(same(x, y) for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
