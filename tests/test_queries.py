"""Every log query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from logfathom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "orders events documents"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([norm(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(repr([norm(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
