"""Rasters and linkages on made-up sheets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import linkages, rasters


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_tiles(spark):
    for w, h, size, overlap in ((100, 60, 40, 10), (30, 30, 40, 10), (81, 40, 40, 0)):
        cover = np.zeros((h, w), bool)
        for x0, y0, x1, y1 in rasters.tiles(w, h, size, overlap):
            assert 0 <= x0 < x1 <= w and 0 <= y0 < y1 <= h and x1 - x0 == min(size, w) and y1 - y0 == min(size, h)
            cover[y0:y1, x0:x1] = True
        assert cover.all()
    got = rasters.tiled(rows(spark, "sheet long, width int, height int", (1, 100, 60)), 40, 10).collect()
    assert len(got) == len(rasters.tiles(100, 60, 40, 10))


def test_masks():
    mask = rasters.drawn(np.array([[5.0, 20, 55, 20], [30, 2, 30, 38], [500, 0, 600, 0]]), 60, 40, 5.0)
    assert mask[20, 30] and mask[22, 10] and not mask[24, 10] and not mask[0, 0]
    d = rasters.distances(mask)
    y, x = np.nonzero(mask)
    for p in ((0, 0), (39, 59), (10, 45), (20, 30)):
        assert d[p] == pytest.approx(np.hypot(y - p[0], x - p[1]).min())
    thin = rasters.thinned(mask)
    assert (thin <= mask).all() and thin.sum() < mask.sum() / 3
    found = rasters.junctions(thin)
    assert len(found) == 1 and math.hypot(found[0][0] - 30, found[0][1] - 20) < 3
    assert np.isinf(rasters.distances(np.zeros((3, 3), bool))).all()
    scores = rasters.buffered_scores(thin, rasters.thinned(np.roll(mask, 1, axis=0)), np.ones_like(mask), 2.5)
    assert scores["f1"] > 0.9 and rasters.buffered_scores(thin, np.zeros_like(mask), np.ones_like(mask), 2.5)["f1"] == 0.0


def test_zones_and_colours():
    raster = np.ones((10, 10))
    assert rasters.zonal_sum(raster, np.array([[2.0, 2], [6, 2], [6, 5], [2, 5]])) == 12.0
    raster[:, :5] = 0.1
    assert rasters.off_road(raster, (0, 0, 3, 9)) and not rasters.off_road(raster, (6, 0, 9, 9)) and not rasters.off_road(raster, (50, 0, 60, 9))
    lab = np.zeros((40, 40, 3))
    lab[:20, :20, 1] = 30.0
    assert rasters.filled_labels(lab, [(5, 5, 10, 10), (30, 30, 35, 35)]) == [(0.0, 30.0), None]
    assert len(rasters.palette(np.array([[0.0, 0, 0], [1, 0, 0], [9, 0, 0]]), 5.0)) == 2
    assert rasters.dice_loss(np.ones(4), np.ones(4)) == 0.0


def test_street_masks(spark):
    sheets = rows(spark, "sheet long, width int, height int", (1, 60, 40), (2, 10, 10))
    lines = rows(spark, "sheet long, x0 double, y0 double, x1 double, y1 double", (1, 5.0, 20.0, 55.0, 20.0), (1, 30.0, 2.0, 30.0, 38.0))
    got = {r["sheet"]: (r["roads"] > 0, r["junctions"]) for r in rasters.street_masks(lines, sheets, 5.0).collect()}
    assert got == {1: (True, 1), 2: (False, 0)}


def test_control_points(spark):
    labels = rows(spark, "sheet long, key long, street string, x double, y double, dir double", (1, 1, "A", 0.0, 50.0, 0.0), (1, 2, "B", 80.0, 0.0, math.pi / 2), (1, 3, "A", 20.0, 50.0, 0.0), (1, 4, "C", 0.0, 90.0, 0.0), (2, 5, "B", 1.0, 1.0, 0.0))
    crossings = rows(spark, "a string, b string, lon double, lat double", ("A", "B", -90.0, 40.0), ("A", "C", -91.0, 40.0))
    found = linkages.control_points(labels, crossings)
    assert {(r["a"], r["b"], round(r["x"]), round(r["y"]), r["lon"]) for r in found.collect()} == {(1, 2, 80, 50, -90.0), (3, 2, 80, 50, -90.0)}
    assert [r["a"] for r in linkages.closest_of_each(found).collect()] == [3]


def test_places(spark):
    points = rows(spark, "id long, x double, y double", (1, 0.0, 0.0), (2, 100.0, 100.0))
    lines = rows(spark, "key string, x0 double, y0 double, x1 double, y1 double", ("long", -900.0, 8.0, 900.0, 8.0), ("far", 300.0, 300.0, 400.0, 300.0))
    assert [r["key"] for r in linkages.corridor(points, lines, 10.0).collect()] == ["long"]
    vertices = rows(spark, "key string, x double, y double", ("a", 1.0, 1.0), ("a", 50.0, 50.0), ("b", 9.0, 9.0))
    assert [r["key"] for r in linkages.in_rectangles(vertices, rows(spark, "id long, x0 double, y0 double, x1 double, y1 double", (1, 40.0, 40.0, 60.0, 60.0))).collect()] == ["a"]
    found = linkages.correspondences(rows(spark, "page string", ("p12",), ("p7b",)), rows(spark, "text string, x double, y double", ("12", 1.0, 1.0), ("7", 50.0, 1.0), ("x", 0.0, 0.0)))
    assert {(r["page"], r["x"]) for r in found.collect()} == {("p12", 1.0), ("p7b", 50.0)}
    frames = rows(spark, "page string, ring array<array<double>>", *[(p, [[0.0, -9.0], [9.0, -9.0], [9.0, 9.0], [0.0, 9.0]]) for p in ("p12", "p7b")])
    assert [r["page"] for r in linkages.inlier_pages(found, frames, (1.0, 0.0, 0.0, 0.0)).collect()] == ["p12"]


def test_keys_and_items(spark):
    known = rows(spark, "key string", ("12",), ("35A",), ("35B",))
    got = {(r["page"], r["key"]) for r in linkages.matching_keys(rows(spark, "page string", ("p12",), ("p35",), ("p35b",), ("p12s",), ("p9",)), known).collect()}
    assert got == {("p12", "12"), ("p35", "35A"), ("p35", "35B"), ("p35b", "35B"), ("p12s", "12")}
    meta = "array<struct<label:string,value:string>>"
    items = rows(spark, f"id string, source string, label string, metadata {meta}", ("s/1__2/georef", "x/1950-0007/info.json", "t", [("streets", "3")]), ("a", "x/1950-0008/info.json", "t [3]", None), ("b", "x/1950-0009/info.json", "t [4]", [("streets", "1")]), ("c", None, "nothing", None))
    files = rows(spark, "page string, path string", ("p7__2", "f7"), ("p8", "f8"))
    found = {r["id"]: (r["page"], r["path"], r["skipped"]) for r in linkages.rewritten_items(items, files).collect()}
    assert found["s/1__2/georef"] == ("p7__2", "f7", None) and found["a"] == ("p8__3", "f8", None) and found["b"] == ("p9", None, "no image") and found["c"][2] == "no page key"
    edges = rows(spark, "a string, b string", ("1", "2"), ("2", "1"), ("1", "3"), ("1", "9"))
    truth = rows(spark, "a string, b string", ("2", "1"), ("2", "3"))
    assert tuple(linkages.scored_edges(edges, truth).first()) == (1, 1, 1, 2, 0.5)


def test_volumes_and_rings(spark):
    poses = rows(spark, "volume long, page string, theta double", *[(1, f"p{i}", t) for i, t in enumerate((1.0, 91.0, -1.0, 180.0, 40.0, 0.0, 0.0, 0.0))])
    out = {r["page"] for r in linkages.turned_off(poses, 15.0).where("outlier").collect()}
    assert out == {"p4"}
    errors = rows(spark, "volume long, page string, rmse double", (1, "p1", 10.04), (1, "p2", 30.0), (1, "p3", None))
    got = linkages.truth_metrics(errors).first()
    assert (got["n"], got["median"], got["by_page"]) == (2, pytest.approx(20.02), {"p1": 10.0, "p2": 30.0})
    sheets = rows(spark, "volume long, sheet long, key string, x double, y double", (1, 1, "a", 0.0, 0.0), (1, 2, "b", 0.0, 0.0))
    assert [r["key"] for r in linkages.key_map_union(sheets, rows(spark, "volume long, sheet long", (1, 2))).collect()] == ["a"]
    from plumbline.functions import geo

    items = spark.range(1).select("id", F.lit(100.0).alias("width"), F.lit(50.0).alias("height"), geo.affine(1e-5, 0, -90, 0, -1e-5, 40).alias("affine"))
    ring = linkages.metre_rings(linkages.footprints(items), -90.0, 40.0).first()["ring"]
    assert ring[2][0] == pytest.approx(1e-3 * 111_320 * math.cos(math.radians(40))) and ring[2][1] == pytest.approx(-5e-4 * 110_540)
    assert linkages.item_stats(rows(spark, "page string, rmse double", ("p1", 2.0)), rows(spark, "index int, page string", (3, "p1"))).first()["index"] == 3
