"""Every registered query against its SQL in DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

from tracemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) else repr(v)
    return str(v)


def rows(columns, data):
    order = sorted(columns)
    place = [columns.index(c) for c in order]
    return order, sorted(tuple(cell(r[i]) for i in place) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got[1]) >= 1
        return
    want = oracle.sql(sql)
    assert got == rows(list(want.columns), want.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
