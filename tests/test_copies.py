"""Queries on many rows of one place or name: right, and done before a deadline that work on every pair would miss."""

import random
import statistics
import threading
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import decisions, registry


@pytest.fixture
def within_deadline(spark, tmp_path):
    """The rows of a query over tables (name to DataFrame), whose jobs are cancelled after 45 s."""

    def rows(name, **tables):
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, name, True)
        timer = threading.Timer(45, spark.sparkContext.cancelJobGroup, [group])
        timer.start()
        try:
            return registry.QUERIES[name](spark, str(tmp_path)).collect()
        finally:
            timer.cancel()
            spark.sparkContext.setJobGroup("", "")

    return rows


def keys(spark, n, step, name):
    return spark.range(n).select((F.col("id") * step).alias(name))


def test_parts_of_one_name(spark, within_deadline):
    parts = spark.range(200_000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") > 0, F.lit("Old-plate")).alias("p_name"))
    got = within_deadline("canonical_match", part=parts)
    assert len(got) == 199_999 and {tuple(r)[1:] for r in got} == {(1, 199_999)}


def test_neighbours_in_one_place(spark, within_deadline):
    got = within_deadline("knn_offsets", supplier=keys(spark, 5_000, 1000, "s_suppkey"), customer=keys(spark, 200_000, 1000, "c_custkey"))
    assert len(got) == 5_000 and {tuple(r)[1:] for r in got} == {(5, 0.0, 0.0)}


def test_land_of_equal_sheets(spark, within_deadline):
    got = within_deadline("sheet_land", supplier=keys(spark, 5_000, 35_000, "s_suppkey"), customer=keys(spark, 50_000, 1000, "c_custkey"))
    assert len(got) == 5_000 and {r["land"] for r in got} == {1.0}


def test_scales_of_one_place(spark, within_deadline):
    k = [i * 997_000 for i in range(60_000)]
    scale = [2.0 ** (i % 3) * (1 + i % 7 / 100) for i in k]
    got = within_deadline("local_scales", customer=keys(spark, len(k), 997_000, "c_custkey"))
    order = sorted(scale)
    without = {s: statistics.median([*order[: (at := order.index(s))], *order[at + 1 :]]) for s in set(scale)}
    assert {r["page"]: (r["n"], r["median"]) for r in got} == {i: (len(k) - 1, round(without[s], 6)) for i, s in zip(k, scale, strict=True)}


@pytest.mark.parametrize("cube", [0, 10**9])
def test_medians_around_places(monkeypatch, cube):
    monkeypatch.setattr(decisions, "CUBE", cube)
    rng = random.Random(4)
    points = [(rng.randrange(12) / 2, rng.randrange(12) / 2, rng.choice([1.0, 1.5, 2.0, 7.0, None])) for _ in range(300)]
    held = sorted({(p, points.count(p)) for p in points if p[2] is not None}, key=lambda h: h[0][2])
    x, y, known = (np.array(c) for c in ([p[0] for p in points], [p[1] for p in points], [p[2] is not None for p in points]))
    own = np.array([np.nan if p[2] is None else p[2] for p in points])
    u, v, scale, weight = (np.array(c) for c in zip(*((*p, n) for p, n in held), strict=True))
    n, median = decisions._weighted_medians(x, y, own, known, u, v, scale, weight.astype(int), 1.0, 0.5)
    for i, p in enumerate(points):
        near = [q[2] for j, q in enumerate(points) if j != i and q[2] is not None and abs(p[0] - q[0]) <= 1.0 and abs(p[1] - q[1]) <= 0.5]
        assert n[i] == len(near) and (not near or median[i] == statistics.median(near))


def test_gaps_need_no_row_for_each_sheet_and_key(spark, tmp_path):
    from plumbline.operators import adjacency

    spark.range(8).select((F.col("id") % 2).alias("l_orderkey"), (F.col("id") * 2).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = registry.QUERIES["missing_numbers"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
    labels = spark.createDataFrame([(s, k) for s in (1, 2) for k in ("3", "4", "6")] + [(2, "5"), (3, None)], "sheet long, label string")
    graph = spark.createDataFrame([(a, b) for a in "3456789" for b in "3456789" if abs(int(a) - int(b)) in (1, 2)], "key string, other string")
    wanted = spark.createDataFrame([(k,) for k in "5678"], "key string")
    both = wanted.crossJoin(labels.select("sheet").distinct())
    found, same = (sorted(map(tuple, adjacency.gap_repairs(labels, graph, graph.limit(0), w).collect())) for w in (wanted, both))
    assert found == same == [(1, "5", 3.0, ["3", "4", "6"], []), (2, "7", 2.0, ["5", "6"], [])]
