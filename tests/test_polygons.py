"""Overlays and repairs against counted points and known shapes."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import polygons


def inside(p, x, y):
    q = np.roll(p, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((p[:, 1] > y) != (q[:, 1] > y)) & (x < (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0])
    return hit.sum() % 2 == 1


def test_clip_equals_counted_points():
    star = np.array([[0, 0], [4, 1], [8, 0], [6, 4], [8, 8], [4, 6], [0, 8], [2, 4]], float)
    turned = np.array([[4, -1], [9, 4], [4, 9], [-1, 4]], float)
    grid = (np.arange(400) + 0.5) / 40 - 1
    for convex in (turned, turned[::-1], turned * 0.5, turned + 100):
        counted = sum(inside(star, x, y) and inside(convex, x, y) for x in grid[::4] for y in grid[::4]) / 100
        assert abs(polygons.common_area(star, convex) - counted) < 0.6
    assert polygons.common_area(star, star[[0, 2, 4, 6]]) == abs(polygons.signed_area(star))


def test_spikes_go_and_shapes_stay():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    spiked = np.array([[0, 0], [4, 0], [4, 2], [9, 2], [4, 2.0], [4, 4], [4, 4], [0, 4]], float)
    assert polygons.without_spikes(square).tolist() == square.tolist()
    assert abs(polygons.signed_area(polygons.without_spikes(spiked))) == 16.0
    assert len(polygons.without_spikes(spiked)) < len(spiked) - 2


def test_nulls_and_flat_rings(spark):
    rows = [(None, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), ([], []), ([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]], [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])]
    df = spark.createDataFrame(rows, "ring array<array<double>>, convex array<array<double>>")
    got = [r["iou"] for r in df.coalesce(1).select(polygons.overlay("ring", "convex").alias("o")).select("o.iou").collect()]
    assert got == [0.0, 0.0, 0.0, 1.0]
    assert df.select(polygons.repaired("ring")).count() == 4


def test_equal_footprints_are_overlaid_once(spark, monkeypatch, tmp_path):
    log = tmp_path / "pairs"

    @F.pandas_udf("struct<overlap double, containment double, iou double>")
    def noted(ring: pd.Series, convex: pd.Series) -> pd.DataFrame:
        with open(log, "a") as f:
            f.write("x" * len(ring))
        return pd.DataFrame({"overlap": [4.0] * len(ring), "containment": [1.0] * len(ring), "iou": [1 / 3] * len(ring)})

    monkeypatch.setattr(polygons, "overlay", noted)
    box = F.expr("array(array(0D, 0D), array(2D, 0D), array(2D, 2D), array(0D, 2D))")
    found = polygons.overlapping(spark.range(60).select("id", box.alias("ring")), spark.range(70).select(F.col("id").alias("fid"), box.alias("convex")), 40.0, 1.0, 6)
    rows = found.collect()
    assert len(rows) == len({(r["id"], r["fid"]) for r in rows}) == 60 * 70 and {tuple(r)[2:] for r in rows} == {(4.0, 1.0, 0.333333)}
    assert log.stat().st_size <= 2  # one pair, which a filter may compute twice
