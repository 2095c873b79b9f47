"""The corpus operators that SQL can express, against it on the smallest tables."""

import os

import duckdb
import pytest

from logfathom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want
