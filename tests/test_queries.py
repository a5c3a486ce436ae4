"""Each query with SQL against DuckDB on the smallest tables, under two numbers of shuffle partitions."""

import os

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.repartition(3).collect())
    out = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want
