"""Reviews on small tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import reviews


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_merged_candidates(spark):
    schema = "page long, option long, score double, lon double, lat double, theta double"
    c = rows(spark, schema, (1, 0, 2.0, 0.0, 0.0, 0.0), (1, 1, 1.9, 0.0001, 0.0, 355.0), (1, 2, 1.8, 0.0, 0.0, 180.0), (1, 3, 1.7, 0.01, 0.0, 0.0), (1, 4, 1.6, 0.5, 0.0, 0.0), (2, 0, 1.0, 0.0, 0.0, 0.0), (2, 1, None, 0.0, 0.0, 0.0))
    got = {(r["page"], r["option"], r["rank"]) for r in reviews.merged_candidates(c, 3).collect()}
    assert got == {(1, 0, 0), (1, 2, 1), (1, 3, 2), (2, 0, 0)}


def test_merged_hypotheses(spark):
    at = lambda dlat: geo.affine(1e-6, 0, -90, 0, -1e-6, F.lit(40.0) + dlat)
    base = rows(spark, "page long, option long, d double, points int, source string", (1, 0, 0.0, 2, "a"), (1, 1, 1e-5, 5, "b"), (1, 2, 1e-3, 1, "c"), (1, 3, None, 9, "none"))
    poses = base.select("page", "option", F.when(F.col("d").isNotNull(), at(F.col("d"))).alias("affine"), "points", "source")
    got = {r["option"]: (r["points"], r["sources"]) for r in reviews.merged_hypotheses(poses).collect()}
    assert got == {0: (5, ["a", "b"]), 2: (1, ["c"])}


def test_views(spark):
    schema = "text string, confidence double, short_side double, long_side double, ignore boolean"
    labels = rows(spark, schema, ("Main St", 0.9, 20.0, 60.0, None), ("Main St", 0.9, 8.0, 60.0, None), ("Main St", 0.25, 8.0, 60.0, None), ("Main St", 0.9, 20.0, 60.0, True), ("Elm", 0.9, 20.0, 60.0, None), ("Main St", 0.9, 20.0, 21.0, None))
    show = lambda **more: sorted((r["short_side"], r["relaxed"]) for r in reviews.shown_labels(labels, "st", least=0.2, min_short=12.0, min_long=30.0, aspect=1.5, **more).collect())
    assert show() == [(20.0, False)] and show(share=0.5) == [(8.0, True), (20.0, False)] and len(show(ignored=True)) == 2
    assert reviews.shown_boxes(labels, 12.0, 50.0).count() == 3
    score = spark.range(1).select(reviews.join_score(F.lit(True), F.lit(True), F.lit(10**6), F.lit(0.5), F.lit(0.25), F.lit(5.0)), reviews.join_score(F.lit(True), F.lit(False), F.lit(10**6), F.lit(0.5), F.lit(0.25), F.lit(5.0))).first()
    assert score[0] == pytest.approx(0.75 - 5.0 / reviews.STRIP_CLAMP_M) and score[1] == float("-inf")
    land = reviews.with_land(rows(spark, "page string, area double", ("a", 10.0), ("b", 4.0)), rows(spark, "page string, land double", ("a", 0.5)))
    assert {r["page"]: r["land_area"] for r in land.collect()} == {"a": 5.0, "b": 4.0}
    assert {r["key"]: r["n"] for r in reviews.panel_counts(rows(spark, "page string, panel int", ("p2", 1), ("p2", 2), ("pa", 1))).collect()} == {"2": 2}


def test_matched_iou(spark):
    box = lambda x, w: [[x, 0.0], [x + w, 0.0], [x + w, 10.0], [x, 10.0]]
    schema = "page long, panel int, ring array<array<double>>"
    truth = rows(spark, schema, (1, 1, box(0.0, 10.0)), (1, 2, box(10.0, 10.0)), (2, 1, box(0.0, 10.0)))
    found = rows(spark, schema, (1, 1, box(10.0, 10.0)), (1, 2, box(0.0, 5.0)), (1, 3, box(50.0, 1.0)), (3, 1, box(0.0, 1.0)))
    got = {r["page"]: (r["n"], r["m"], round(r["iou"], 6)) for r in reviews.matched_iou(truth, found).collect()}
    assert got == {1: (2, 3, 0.5), 2: (1, 0, 0.0), 3: (0, 1, 0.0)}
