"""Stages are made once, again when what they depend on changed, and in order."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import stages


def doubled(spark, tables, params):
    return tables["numbers"].select((F.col("id") * params["by"]).alias("n"))


def summed(spark, tables, params):
    return tables["doubled"].agg(F.sum("n").alias("total"))


def test_run(spark, tmp_path):
    numbers = spark.range(5)
    make = lambda by: [stages.Stage("summed", ("doubled",), summed), stages.Stage("doubled", ("numbers",), doubled, {"by": by})]
    go = lambda by, version="1": stages.run(spark, make(by), {"numbers": numbers}, f"{tmp_path}/run", version)
    tables, records = go(2)
    assert tables["summed"].first()["total"] == 20 and [(r["stage"], r["made"]) for r in records] == [("doubled", True), ("summed", True)]
    assert [r["made"] for r in go(2)[1]] == [False, False]
    tables, records = go(3)
    assert tables["summed"].first()["total"] == 30 and [r["made"] for r in records] == [True, True]
    assert [r["made"] for r in go(3, "2")[1]] == [True, True]


def test_order():
    a, b = stages.Stage("a", ("x",), summed), stages.Stage("b", ("a",), summed)
    assert [s.name for s in stages.ordered([b, a], ["x"])] == ["a", "b"]
    with pytest.raises(ValueError, match="no stage makes x"):
        stages.ordered([a])
    with pytest.raises(ValueError, match="circle"):
        stages.ordered([stages.Stage("a", ("b",), summed), b])
    with pytest.raises(ValueError, match="one name"):
        stages.ordered([a, a], ["x"])


def test_fetched():
    waits, left = [], [OSError(), OSError(), b"ok"]

    def open_url(url):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert stages.fetched("u", open_url, 3, 1.0, waits.append) == b"ok" and waits == [1.0, 2.0]
    left[:] = [OSError("down")] * 2
    with pytest.raises(OSError, match="down"):
        stages.fetched("u", open_url, 2, 1.0, waits.append)
