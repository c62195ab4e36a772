"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lawlake.plans import further, problems, reference, structure  # noqa: F401

D = "/root/testdata/sf0.001"
QUERIES, SQL = problems.QUERIES | reference.QUERIES, problems.SQL | reference.SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(v):
    return ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in rel.fetchall()), key=repr)
