"""Placements against truth and against each other: errors over a region, sweeps of gates, joint choices by overlap, runs compared, and axes of streets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import documents as docs, geo
from plumbline.operators import faces, graph
from plumbline.plans import decisions
from plumbline.session import table

#: Lattices over a region, from coarse to fine, and places inside that are enough, and few at least.
LATTICES, ENOUGH, FEW = (7, 11, 15, 21, 31), 49, 5
#: Shares of overlap that are free, and that are barred, when poses are chosen together.
SOFT, HARD = 0.15, 0.5


def region_grid(ring: Column) -> Column:
    """Places [x, y] inside a ring at even shares of its box: of the first lattice that has enough, else the last one's; all of that if too few are inside."""
    x0, y0, x1, y1 = geo.ring_bbox(ring)

    def lattice(n: int) -> Column:
        at = F.array(*[F.lit((k + 1) / (n + 1)) for k in range(n)])
        return F.flatten(F.transform(at, lambda v: F.transform(at, lambda u: F.array(x0 + u * (x1 - x0), y0 + v * (y1 - y0)))))

    held = [(n, F.filter(lattice(n), lambda p: geo.in_ring(ring, p[0], p[1]))) for n in LATTICES]
    found = F.when(F.size(held[-1][1]) >= FEW, held[-1][1]).otherwise(lattice(LATTICES[-1]))
    for _, inside in reversed(held[:-1]):
        found = F.when(F.size(inside) >= ENOUGH, inside).otherwise(found)
    return found


def region_rmse_ft(truth: Column, placed: Column, grid: Column) -> Column:
    """Root mean square of the feet between two poses over places of a grid."""
    def square(p: Column) -> Column:
        (xa, ya), (xb, yb) = geo.apply_affine(truth, p[0], p[1]), geo.apply_affine(placed, p[0], p[1])
        d = geo.haversine_m(xa, ya, xb, yb) * geo.FEET
        return d * d

    return F.sqrt(F.aggregate(grid, F.lit(0.0), lambda t, p: t + square(p)) / F.nullif(F.size(grid), F.lit(0)))


def analysis(truth: Column, placed: Column, width: Column, height: Column) -> dict[str, Column]:
    """What a placement is off its truth: feet, degrees, the ratio of scales, and how far the truth itself is from a similarity."""
    skew, ratio = geo.distortion(truth)
    return {
        "rmse_ft": decisions.rmse_ft(truth, placed, width, height), "turn_deg": geo.angle_difference(geo.north_angle(placed), geo.north_angle(truth)),
        "scale_ratio": geo.px_per_ft(placed) / geo.px_per_ft(truth), "skew_deg": skew, "anisotropy": ratio,
    }


def swept(rows: DataFrame, gates: list[float]) -> DataFrame:
    """(gate, accepted, good, bad, net) of choices (score, rmse) that each gate lets in: those within 25 ft, at 200 or more, and the difference."""
    counts = []
    for g in gates:
        kept = F.col("score") >= g
        counts.append(F.struct(F.lit(float(g)).alias("gate"), F.count_if(kept).alias("accepted"), F.count_if(kept & (F.col("rmse") <= 25)).alias("good"), F.count_if(kept & (F.col("rmse") >= 200)).alias("bad")))
    each = rows.agg(F.array(*counts).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    return each.withColumn("net", F.col("good") - F.col("bad"))


def chosen_together(options: DataFrame, soft: float = SOFT, hard: float = HARD) -> DataFrame:
    """(node, option): a pose of each page (node, option from 0, score, ring in metres, published) so that scores are high and footprints apart.

    An option without a ring is no placement. Overlap is the share of the smaller footprint; pages whose
    options may overlap are chosen together.
    """
    rings = options.where("ring IS NOT NULL").select(F.struct("node", "option").alias("id"), "ring")
    keyed = rings.select((F.col("id.node") * 1000 + F.col("id.option")).alias("id"), "ring")
    area = keyed.select("id", geo.ring_area(F.col("ring")).alias("area"))
    met = faces.overlaps(keyed, keyed).where("id < other").join(area, "id").join(area.toDF("other", "area2"), "other")
    node, option = (lambda c: F.floor(F.col(c) / 1000).cast("long")), (lambda c: (F.col(c) % 1000).cast("int"))
    cost = geo.overlap_cost(F.col("common") / F.least("area", "area2"), F.lit(soft), F.lit(hard))
    pairs = met.select(node("id").alias("a"), option("id").alias("oa"), node("other").alias("b"), option("other").alias("ob"), cost.alias("energy")).where("a <> b AND energy > 0")
    return graph.joint_choice(options.select("node", F.col("option").cast("int").alias("option"), (-F.col("score")).alias("unary"), "published"), pairs)


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page, before, after, change, delta) of two runs' errors (page, rmse; null where unplaced): placed, lost, better, worse or same."""
    both = before.select("page", F.col("rmse").alias("before")).join(after.select("page", F.col("rmse").alias("after")), "page", "full")
    b, a = F.col("before"), F.col("after")
    change = F.when(b.isNull() & a.isNull(), "same").when(b.isNull(), "placed").when(a.isNull(), "lost").when(a < b, "better").when(a > b, "worse").otherwise("same")
    return both.select("page", "before", "after", change.alias("change"), (a - b).alias("delta"))


def pose_documents(poses: DataFrame) -> DataFrame:
    """(page, document): poses (page, affine, width, height, streets, crossings, params) as JSON sidecars, corners TL, TR, BR, BL."""
    w, h, o = F.col("width"), F.col("height"), F.lit(0.0)
    corner = lambda x, y: F.array(*geo.apply_affine(F.col("affine"), x.cast("double"), y.cast("double")))
    corners = F.when(F.col("affine").isNotNull(), F.array(corner(o, o), corner(w, o), corner(w, h), corner(o, h)))
    return poses.select("page", F.to_json(F.struct("width", "height", corners.alias("corners"), "streets", F.col("crossings").alias("intersections"), F.col("params").alias("parameters"))).alias("document"))


def masked(ring: Column, affine: Column, kx: Column, ky: Column) -> Column:
    """The SVG selector of a ring of [lon, lat] on a sheet's canvas, which is kx by ky times the pixels of its pose; null without a pose."""
    inverse = geo.invert_affine(affine)
    pixel = lambda p: geo.apply_affine(inverse, p[0], p[1])
    return F.when(inverse.isNotNull(), docs.svg_polygon(F.transform(ring, lambda p: F.array(pixel(p)[0] * kx, pixel(p)[1] * ky))))


def street_axes(segments: DataFrame) -> DataFrame:
    """(street, axis, metres): the direction, modulo a half turn in degrees, of most of a street's length (street, dx, dy in metres), by doubled angles."""
    length = F.hypot("dx", "dy")
    double = lambda of: F.sum(length * of(2 * F.atan2("dy", "dx")))
    made = segments.where(length > 0).groupBy("street").agg(double(F.sin).alias("s"), double(F.cos).alias("c"), F.sum(length).alias("metres"))
    return made.select("street", F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)).alias("axis"), "metres")


def segments_about(segments: DataFrame, lon: Column, lat: Column, metres: float) -> DataFrame:
    """Segments (x0, y0, x1, y1 in degrees) that come within metres of a place."""
    return segments.where(geo.segment_distance_m(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), lon, lat) <= metres)


def straight_crossing(ax: Column, ay: Column, axis_a: Column, bx: Column, by: Column, axis_b: Column) -> Column:
    """Struct (x, y) where straight streets through two places cross, by their axes in degrees; null where they are nearly parallel."""
    da, db = F.radians(axis_a), F.radians(axis_b)
    det = F.sin(db - da)
    t = ((bx - ax) * F.sin(db) - (by - ay) * F.cos(db)) / F.when(F.abs(det) >= math.sin(math.radians(10)), det)
    return F.when(t.isNotNull(), F.struct((ax + t * F.cos(da)).alias("x"), (ay + t * F.sin(da)).alias("y")))


def relative_turns(joins: DataFrame, poses: DataFrame) -> DataFrame:
    """(volume, page, turn): the direction of each page that its neighbours' poses (volume, page, theta in degrees) and joins (volume, a, b, dtheta) agree on: the circular mean."""
    way = lambda here, there, sign: joins.select("volume", F.col(here).alias("page"), F.col(there).alias("other"), (F.col("dtheta") * sign).alias("d"))
    met = way("b", "a", 1).union(way("a", "b", -1)).join(poses.select("volume", F.col("page").alias("other"), "theta"), ["volume", "other"])
    angle = F.radians(F.col("theta") + F.col("d"))
    return met.groupBy("volume", "page").agg(F.pmod(F.degrees(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))), F.lit(360.0)).alias("turn"))


def overlap_pairs(rings: DataFrame) -> DataFrame:
    """(a, b, common, wide, long, gap): pairs of rings (id, ring in metres) that touch: their common area, the sides of the box about it, and how far apart they are."""
    met = faces.adjacent(rings, 0.0).select("a", "b", F.col("distance").alias("gap"))
    both = met.join(faces.overlaps(rings, rings).select(F.col("id").alias("a"), F.col("other").alias("b"), "common"), ["a", "b"], "left")
    box = lambda name, p: rings.select(F.col("id").alias(name), *[v.alias(f"{p}{i}") for i, v in enumerate(geo.ring_bbox(F.col("ring")))])
    both = both.join(box("a", "p"), "a").join(box("b", "q"), "b")
    side = lambda i: F.greatest(F.lit(0.0), F.least(f"p{i + 2}", f"q{i + 2}") - F.greatest(f"p{i}", f"q{i}"))
    return both.select("a", "b", F.coalesce("common", F.lit(0.0)).alias("common"), F.least(side(0), side(1)).alias("wide"), F.greatest(side(0), side(1)).alias("long"), "gap")


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("score"), (F.col("l_quantity") * 6).alias("rmse"))
    return swept(rows, [0.0, 2.5, 5.5, 8.5])


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' best orders of two kinds as two runs."""
    best = lambda *states: table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*states)).groupBy(F.col("o_custkey").alias("page")).agg(F.max("o_totalprice").alias("rmse"))
    found = run_difference(best("F"), best("O", "P"))
    return found.groupBy("change").agg(F.count("*").alias("n"), F.round(F.sum("delta") / 1000, 2).alias("delta"))


def supplier_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = street_axes(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("street"), (F.col("l_quantity") - 20).alias("dx"), (F.col("l_linenumber") * 3.0).alias("dy")))
    return found.select("street", F.round("axis", 5).alias("axis"), F.round("metres", 4).alias("metres"))


QUERIES = {f.__name__: f for f in (gate_counts, order_changes, supplier_axes)}
ORACLES = {
    "gate_counts": """SELECT gate, count(*) FILTER (s >= gate) AS accepted, count(*) FILTER (s >= gate AND r <= 25) AS good, count(*) FILTER (s >= gate AND r >= 200) AS bad, count(*) FILTER (s >= gate AND r <= 25) - count(*) FILTER (s >= gate AND r >= 200) AS net
FROM (SELECT l_discount * 100 AS s, l_quantity * 6 AS r FROM lineitem), (SELECT unnest([0.0, 2.5, 5.5, 8.5])::DOUBLE AS gate) GROUP BY gate""",
    "order_changes": """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1),
c AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.k = b.k) SELECT CASE WHEN x IS NULL THEN 'placed' WHEN y IS NULL THEN 'lost' WHEN y < x THEN 'better' WHEN y > x THEN 'worse' ELSE 'same' END AS change, count(*) AS n, round(sum(y - x) / 1000, 2) AS delta FROM c GROUP BY 1""",
    "supplier_axes": """WITH s AS (SELECT l_suppkey AS street, l_quantity - 20 AS dx, l_linenumber * 3.0::DOUBLE AS dy FROM lineitem), l AS (SELECT *, sqrt(dx * dx + dy * dy) AS m FROM s)
SELECT street, round((degrees(atan2(sum(m * sin(2 * atan2(dy, dx))), sum(m * cos(2 * atan2(dy, dx))))) / 2 + 180) % 180, 5) AS axis, round(sum(m), 4) AS metres FROM l WHERE m > 0 GROUP BY street""",
}
