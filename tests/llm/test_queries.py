"""The queries that SQL can express, with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def value(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[k]) for k in columns) for r in df.collect())
    out = c.execute(registry.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(value(r[names.index(k)]) for k in columns) for r in out.fetchall())
