"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sheafspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: list(map(plain, v)) if isinstance(v, (list, tuple)) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert norm(got, df.columns) == norm(cur.fetchall(), names)
