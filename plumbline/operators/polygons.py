"""Overlay of polygons with convex ones (posed footprints), and repairs of rings, batch by batch.

A ring is an array of [x, y], open or closed, either way round. A ring clipped by a convex ring has the
right area even where it falls apart, as the joining edges have none; that is all these operators use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.operators.copies import classes, member_pairs
from plumbline.session import table


def opened(ring) -> np.ndarray:
    points = np.array([list(p) for p in ring], float).reshape(-1, 2) if ring is not None else np.zeros((0, 2))
    return points[:-1] if len(points) > 1 and (points[0] == points[-1]).all() else points


def signed_area(p: np.ndarray) -> float:
    return float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2


def clipped(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of ring inside a convex ring: one half plane after the other, all of a ring's sides at once."""
    if signed_area(convex) < 0:
        convex = convex[::-1]
    for a, b in zip(convex, np.roll(convex, -1, axis=0)):
        if len(ring) < 3:
            return ring[:0]
        side = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
        after, side_after = np.roll(ring, -1, axis=0), np.roll(side, -1)
        crosses = (side < 0) != (side_after < 0)
        share = np.divide(side, side - side_after, out=np.zeros_like(side), where=crosses)
        slots = np.stack([ring, ring + share[:, None] * (after - ring)], axis=1).reshape(-1, 2)
        ring = slots[np.stack([side >= 0, crosses], axis=1).reshape(-1)]
    return ring


def common_area(ring: np.ndarray, convex: np.ndarray) -> float:
    return abs(signed_area(clipped(ring, convex))) if len(ring) > 2 and len(convex) > 2 else 0.0


def without_spikes(ring: np.ndarray, turn: float = 170.0) -> np.ndarray:
    """The ring without vertices at which it turns by at least ``turn`` degrees, nor repeated ones, until none is left."""
    while len(ring) > 3:
        back, on = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        angle = np.degrees(np.abs(np.arctan2(back[:, 0] * on[:, 1] - back[:, 1] * on[:, 0], (back * on).sum(axis=1))))
        bad = np.flatnonzero((angle >= turn) | (on == 0).all(axis=1))
        if not len(bad):
            break
        ring = np.delete(ring, bad[0], axis=0)  # one at a time: the neighbours' angles change
    return ring


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("overlap", "containment", "iou")]))
def overlay(ring: pd.Series, convex: pd.Series) -> pd.DataFrame:
    """Common area, its share of the convex ring, and of the union; 0 for a null, empty or flat ring."""
    out = []
    for r, c in zip(ring, convex, strict=True):
        a, b = opened(r), opened(c)
        common, area_a, area_b = common_area(a, b), abs(signed_area(a)) if len(a) else 0.0, abs(signed_area(b)) if len(b) else 0.0
        whole = area_a + area_b - common
        out.append((common, common / area_b if area_b > 0 else 0.0, common / whole if whole > 0 else 0.0))
    return pd.DataFrame(out, columns=["overlap", "containment", "iou"])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def repaired(ring: pd.Series) -> pd.Series:
    return ring.map(lambda r: without_spikes(opened(r)).tolist())


def overlapping(rings: DataFrame, footprints: DataFrame, cell: float, least: float, decimals: int | None = None) -> DataFrame:
    """(id, fid, overlap, containment, iou) for pairs that share at least ``least`` area; shares to so many decimals.

    rings: (id, ring); footprints: (fid, convex). Pairs meet on grid cells that both boxes touch, and only in the first such
    cell, so no pair is made twice; a cell should be about the size of a footprint. Pairs whose boxes are apart never reach
    Python, and equal rings and footprints reach it once. The number of partitions is stated, as small tables of many pairs would be put into one task otherwise.
    """
    n = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def boxed(df: DataFrame, ring: str, p: str) -> DataFrame:
        side = lambda of, i, name: of(F.transform(ring, lambda q: q[i])).alias(p + name)
        box = df.where(F.size(ring) > 2).select("*", side(F.array_min, 0, "x0"), side(F.array_min, 1, "y0"), side(F.array_max, 0, "x1"), side(F.array_max, 1, "y1"))
        cells = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{p}{axis}0") / cell), F.floor(F.col(f"{p}{axis}1") / cell)))
        return box.select("*", cells("x").alias("cx")).select("*", cells("y").alias("cy")).repartition(n, "cx", "cy")

    first = lambda axis: F.floor(F.greatest(f"a{axis}0", f"b{axis}0") / cell)
    one, two = classes(rings, "id", "ring"), classes(footprints, "fid", "convex")
    met = boxed(one.drop("members"), "ring", "a").join(boxed(two.drop("members"), "convex", "b"), ["cx", "cy"]).where((F.col("cx") == first("x")) & (F.col("cy") == first("y")))
    met = met.where("ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1")
    found = met.select("id", "fid", overlay("ring", "convex").alias("o")).where(F.col("o.overlap") >= least).select("id", "fid", "o.*")
    share = lambda c: (F.col(c) if decimals is None else F.round(c, decimals)).alias(c)
    return member_pairs(found.select("id", "fid", "overlap", share("containment"), share("iou")), one, two, "id", "fid")


def _box(x, y, w: float, h: float):
    return F.array(*[F.array(x + i, y + j) for i, j in ((0.0, 0.0), (w, 0.0), (w, h), (0.0, h))])


def footprint_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers against boxes of customers, placed by their keys."""
    at = lambda key, m: (F.col(key) * m % 1000).cast("double")
    rings = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), _box(at("s_suppkey", 37), at("s_suppkey", 91), 40.0, 25.0).alias("ring"))
    feet = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), _box(at("c_custkey", 53), at("c_custkey", 17), 30.0, 30.0).alias("convex"))
    return overlapping(rings, feet, 40.0, 1.0, 6)


QUERIES = {"footprint_overlaps": footprint_overlaps}
ORACLES = {
    "footprint_overlaps": """WITH s AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000)::DOUBLE AS x, (s_suppkey * 91 % 1000)::DOUBLE AS y FROM supplier),
c AS (SELECT c_custkey AS fid, (c_custkey * 53 % 1000)::DOUBLE AS u, (c_custkey * 17 % 1000)::DOUBLE AS v FROM customer),
o AS (SELECT id, fid, greatest(0, least(x + 40, u + 30) - greatest(x, u)) * greatest(0, least(y + 25, v + 30) - greatest(y, v)) AS overlap FROM s, c)
SELECT id, fid, overlap, round(overlap / 900, 6) AS containment, round(overlap / (1900 - overlap), 6) AS iou FROM o WHERE overlap >= 1"""
}
