"""The contract queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tidewater.llm.queries import ORACLE, QUERIES


def plain(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(plain(r) for r in df.select(*names).collect()) == sorted(plain(r) for r in want.fetchall())
