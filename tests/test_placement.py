"""Placements on made-up sheets."""




import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import placement


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_region_grid(spark):
    shapes = [box(0.0, 0.0, 10.0, 20.0), [[0.0, 0.0], [10.0, 0.0], [10.0, 2.0], [2.0, 2.0], [2.0, 10.0], [0.0, 10.0]], [[0.0, 0.0], [10.0, 0.0], [10.0, 1e-9]]]
    df = rows(spark, "i int, ring array<array<double>>", *enumerate(shapes))
    grids = {r["i"]: r["g"] for r in df.select("i", placement.region_grid(F.col("ring")).alias("g")).collect()}
    assert len(grids[0]) == 49 and len(grids[1]) >= 49 and all(x < 2 or y < 2 for x, y in grids[1])
    assert len(grids[2]) >= 5
    a, b = geo.affine(1e-6, 0, -90, 0, -1e-6, 40), geo.affine(1e-6, 0, -90, 0, -1e-6, 40.001)
    got = df.where("i = 0").select(placement.region_rmse_ft(a, b, placement.region_grid(F.col("ring"))).alias("r"), *[c.alias(n) for n, c in placement.analysis(a, b, F.lit(10.0), F.lit(10.0)).items()]).first()
    assert got["r"] == pytest.approx(365.2, abs=0.3) and got["rmse_ft"] == pytest.approx(got["r"], abs=0.01) and got["turn_deg"] == 0 and got["scale_ratio"] == pytest.approx(1)


def test_chosen_together(spark):
    schema = "node long, option int, score double, ring array<array<double>>, published boolean"
    options = rows(spark, schema, (1, 0, 1.0, box(0.0, 0.0, 10.0, 10.0), True), (1, 1, 0.0, None, False), (2, 0, 0.9, box(1.0, 0.0, 10.0, 10.0), True), (2, 1, 0.5, box(30.0, 0.0, 10.0, 10.0), False), (2, 2, 0.0, None, False), (3, 0, 0.2, box(90.0, 0.0, 5.0, 5.0), True), (3, 1, 0.0, None, False))
    assert {(r["node"], r["option"]) for r in placement.chosen_together(options).collect()} == {(1, 0), (2, 1), (3, 0)}


def test_documents(spark):
    pose = spark.range(1).select(F.lit("p1").alias("page"), geo.affine(1e-5, 0, -90, 0, -1e-5, 40).alias("affine"), F.lit(100).alias("width"), F.lit(50).alias("height"), F.array().cast("array<string>").alias("streets"), F.array().cast("array<string>").alias("crossings"), F.create_map(F.lit("a"), F.lit("1")).alias("params"))
    import json

    doc = json.loads(placement.pose_documents(pose).first()["document"])
    assert doc["corners"][2] == pytest.approx([-89.999, 39.9995]) and doc["parameters"] == {"a": "1"}
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((-90.0, 40.0), (-89.999, 40.0), (-89.999, 39.9995))])
    got = pose.select(placement.masked(ring, F.col("affine"), F.lit(4.0), F.lit(2.0)).alias("m")).first()["m"]
    assert got == '<svg><polygon points="0.0,0.0 400.0,0.0 400.0,100.0" /></svg>'.replace("0.0,0.0", got.split('"')[1].split(" ")[0]) and [round(float(v)) for p in got.split('"')[1].split(" ") for v in p.split(",")] == [0, 0, 400, 0, 400, 100]


def test_axes_and_turns(spark):
    got = spark.range(1).select(placement.straight_crossing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(-3.0), F.lit(90.0)).alias("p"), placement.straight_crossing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(-3.0), F.lit(175.0)).alias("q")).first()
    assert (round(got["p"]["x"], 9), round(got["p"]["y"], 9), got["q"]) == (5.0, 0.0, None)
    segments = rows(spark, "x0 double, y0 double, x1 double, y1 double", (-90.0, 40.0, -89.99, 40.0), (-90.0, 41.0, -89.99, 41.0))
    assert placement.segments_about(segments, F.lit(-89.995), F.lit(40.0001), 20.0).count() == 1
    joins = rows(spark, "volume long, a string, b string, dtheta double", (1, "x", "y", 10.0), (1, "y", "z", -20.0))
    poses = rows(spark, "volume long, page string, theta double", (1, "x", 350.0), (1, "z", 340.0))
    turns = {r["page"]: round(r["turn"], 6) for r in placement.relative_turns(joins, poses).collect()}
    assert turns["y"] in (0.0, 360.0) and set(turns) == {"y"} | set(turns)
    pairs = placement.overlap_pairs(rows(spark, "id long, ring array<array<double>>", (1, box(0.0, 0.0, 10.0, 10.0)), (2, box(8.0, 0.0, 10.0, 10.0)), (3, box(50.0, 0.0, 1.0, 1.0)))).collect()
    assert [tuple(r) for r in pairs] == [(1, 2, 20.0, 2.0, 10.0, 0.0)]
    changes = placement.run_difference(rows(spark, "page string, rmse double", ("a", 5.0), ("b", None), ("c", 3.0), ("d", 4.0)), rows(spark, "page string, rmse double", ("a", 4.0), ("b", 9.0), ("c", None), ("d", 4.0)))
    assert {r["page"]: r["change"] for r in changes.collect()} == {"a": "better", "b": "placed", "c": "lost", "d": "same"}
