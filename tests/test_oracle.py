"""Every query with an SQL equivalent gives the same rows in DuckDB."""

import duckdb
import pytest

from tidewater.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(row):
    return tuple(repr(float(x) + 0.0) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = sorted(plain(r) for r in df.select(*sorted(df.columns)).collect())
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(plain(tuple(r[i] for i in order)) for r in found.fetchall())


def test_queries_without_sql_have_rows(spark, data):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, data).count() > 0, name
