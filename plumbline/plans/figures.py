"""Queries of poses, scales and places: each line of an order is a sheet whose figures are made of its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import documents, geo
from plumbline.session import table

_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with q (1 to 50), n (1 to 7), and t, an angle of a part."""
    return table(spark, sf_dir, "lineitem").select(*_KEY, F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("double").alias("n"), F.radians(F.col("l_partkey") * 37 % 360).alias("t"), "l_discount", "l_tax")


def _rounded(places: int = 6, **columns: Column) -> list[Column]:
    return [(F.round(c, places) + 0.0).alias(name) for name, c in columns.items()]  # no negative zero


def _pose(q: Column, n: Column, t: Column) -> Column:
    """A pose of some 1e-6 degrees a pixel, turned by t and a little skew, in the middle latitudes."""
    s = q * 1e-6
    return geo.affine(s * F.cos(t), s * F.sin(t) * 1.1, -80 - n, s * F.sin(t) * 0.8, -s * F.cos(t) * 0.75, 30 + n)


def pose_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _sheets(spark, sf_dir).withColumn("m", _pose(c("q"), c("n"), c("t")))
    skew, ratio = geo.distortion(c("m"))
    return rows.select(*_KEY, *_rounded(
        north=geo.north_angle(c("m")), per_ft=geo.px_per_ft(c("m")), text=geo.text_angle(c("m")), scale=geo.pose_scale_log2(c("m")), center=geo.pose_center(c("m"), F.lit(2000.0), F.lit(3000.0))[0],
    ), geo.is_upside_down(c("m")).cast("int").alias("upside_down"), skew.alias("skew"), ratio.alias("ratio"))


def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses in a volume's frame: there and back, and one relative to the next."""
    c = F.col
    pose = lambda x, y, t: F.struct(x.alias("x"), y.alias("y"), t.alias("theta"))
    rows = _sheets(spark, sf_dir).withColumn("a", pose(c("q") * 10, c("n") * 7, geo.wrap_radians(c("t")))).withColumn("b", pose(c("n") * 3, c("q"), geo.wrap_radians(2 * c("t"))))
    back = geo.affine_to_pose(geo.pose_to_affine(c("a"), F.lit(0.25), F.lit(-90.0), F.lit(40.0)), F.lit(-90.0), F.lit(40.0))
    rows = rows.withColumn("back", back).withColumn("r", geo.relative_pose(c("a"), c("b")))
    apart = lambda x, y: F.abs(geo.wrap_radians(x - y))
    return rows.select(*_KEY, *_rounded(5, x=c("back.x"), y=c("back.y"), dx=c("r.x"), dy=c("r.y"), turn=F.cos(c("r.theta"))), (apart(c("back.theta"), c("a.theta")) < 1e-6).cast("int").alias("same"))


def scale_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, priors, sigmas and overlaps."""
    c = F.col
    position, angle = geo.measurement_sigmas(c("q") / 30, c("l_linenumber") % 2 == 0, c("l_partkey") % 3 == 0)
    return _sheets(spark, sf_dir).select(*_KEY, *_rounded(
        least=geo.relaxed_threshold(c("l_discount") * 10, F.lit(0.2), F.lit(12.0), F.lit(6.0)), prior=geo.keep_prior(c("l_linenumber"), c("l_discount") - 0.05), share=geo.overlap_share(c("q") / 50, F.lit(0.15), F.lit(0.5)),
        cost=geo.overlap_cost(c("q") / 50, F.lit(0.15), F.lit(0.5)), position=position, angle=angle, half=geo.region_relative_scale(c("q"), F.lit(30.0)), note=geo.note_m_per_px(c("q"), F.lit(62.5)),
    ), geo.broad_scale_plausible(c("q"), F.lit(7.0)).cast("int").alias("plausible"))


def place_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections, distances to segments, areas and turned pixels."""
    c = F.col
    lon, lat = -90 + c("q") / 1000, 40 + c("n") / 1000
    x, y = geo.project(lon, lat, F.lit(-90.0), F.lit(40.0))
    west, east, south, north = geo.point_bounds(lon, lat, F.lit(500.0))
    u, v = geo.unrotated(90 * (c("l_linenumber") % 4), c("q"), c("n"), F.lit(100.0), F.lit(60.0))
    ring = F.array(*[F.array(F.lit(-90.0 + a), F.lit(40.0 + b) * 1.0 + c("q") * 1e-4 * k) for a, b, k in ((0, 0, 0), (0.01, 0, 0), (0.01, 0.0, 1), (0, 0.0, 1))])
    ax, ay = geo.pose_world(c("q"), c("n"), F.degrees(c("t")), F.ln(c("n")), F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(60.0))
    return _sheets(spark, sf_dir).select(*_KEY, *_rounded(
        3, x=x, y=y, width=(east - west) * 1e6, height=(north - south) * 1e6, away=geo.segment_distance_m(F.lit(-90.0), F.lit(40.0), F.lit(-89.99), F.lit(40.005), lon, lat), u=u, v=v, area=geo.ring_area_m2(ring) / 1000, east=ax, north=ay,
        miles=geo.distance_miles(F.lit(-90.0), F.lit(40.0), lon, lat) * 1000,
    ))


def crossing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as crossings of its sheet: inliers, streets among them, and what its metadata says."""
    c = F.col
    one = F.struct(c("l_partkey").alias("street"), (c("l_quantity") * 10).alias("x"), (c("l_linenumber") * 40).alias("y"), (c("l_returnflag") == "N").alias("inlier"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("found"))
    entries = documents.georef_metadata(c("found"), c("found"))
    return rows.select("l_orderkey", documents.inlier_count(c("found")).alias("inliers"), documents.inlier_streets(c("found")).alias("streets"), documents.metadata_int(entries, "intersections").alias("noted"), (documents.effective_crossings(c("found")) <= documents.inlier_count(c("found"))).cast("int").alias("fewer"))


QUERIES = {f.__name__: f for f in (pose_figures, frame_round_trip, scale_rules, place_figures, crossing_counts)}
_K = ", ".join(_KEY)
_SHEETS = f"s AS (SELECT {_K}, l_quantity AS q, l_linenumber::DOUBLE AS n, radians(l_partkey * 37 % 360) AS t, l_discount, l_tax FROM lineitem)"
_FT = "(pi() * 20925524.0 / 180)"
_HAV = "(2 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
ORACLES = {
    "pose_figures": f"""WITH {_SHEETS}, m AS (SELECT *, q * 1e-6 * cos(t) AS a, q * 1e-6 * sin(t) * 1.1 AS b, q * 1e-6 * sin(t) * 0.8 AS d, -q * 1e-6 * cos(t) * 0.75 AS e, cos(radians(30 + n)) AS k FROM s),
v AS (SELECT *, sqrt(a * a * k * k + d * d) AS ux, sqrt(b * b * k * k + e * e) AS vx, degrees(atan2(d * 110540, a * 111320 * k)) AS txt FROM m)
SELECT {_K}, round((degrees(atan2(e, d)) + 360) % 360, 6) AS north, round(1 / (sqrt(d * d + e * e) * {_FT}), 6) AS per_ft, round((txt + 360) % 360, 6) AS text, round(log2(sqrt(pow(a * 111320 * k, 2) + pow(d * 110540, 2))), 6) AS scale,
  round(a * 1000 + b * 1500 + (-80 - n), 6) AS center, CASE WHEN (txt + 360) % 360 BETWEEN 112 AND 247 THEN 1 ELSE 0 END AS upside_down,
  round(degrees(acos(greatest(-1, least(1, (a * k * b * k + d * e) / (ux * vx))))) - 90, 2) AS skew, round(ux / vx, 3) AS ratio FROM v""",
    "frame_round_trip": f"""WITH {_SHEETS}, w AS (SELECT *, t - CASE WHEN t >= pi() THEN 2 * pi() ELSE 0 END AS wt, n * 3 - q * 10 AS ex, q - n * 7 AS ey FROM s)
SELECT {_K}, round(q * 10, 5) AS x, round(n * 7, 5) AS y, round(cos(wt) * ex + sin(wt) * ey, 5) + 0.0 AS dx, round(cos(wt) * ey - sin(wt) * ex, 5) + 0.0 AS dy, round(cos(t), 5) + 0.0 AS turn, 1 AS same FROM w""",
    "scale_rules": f"""WITH {_SHEETS}, w AS (SELECT *, l_discount * 10 AS conf, q / 50 AS iou, q / 30 AS ver, (CASE WHEN l_linenumber % 2 = 0 THEN 1.5 ELSE 1 END) * (CASE WHEN l_partkey % 3 = 0 THEN 1.5 ELSE 1 END) AS f FROM s)
SELECT {_K}, round(CASE WHEN conf <= 0.2 THEN 12.0 ELSE 12.0 * pow(0.2 / least(conf, 1.0), ln(0.5) / ln(0.2)) END, 6) AS least,
  round(CASE WHEN l_linenumber <= 1 THEN CASE WHEN l_discount - 0.05 >= 0 THEN 0.69 ELSE 0 END WHEN l_linenumber <= 3 THEN CASE WHEN l_discount - 0.05 >= 0 THEN 0.68 ELSE 0.25 END ELSE CASE WHEN l_discount - 0.05 >= 0 THEN 0.94 ELSE 0.57 END END, 6)::DOUBLE AS prior,
  round(CASE WHEN iou <= 0.15 THEN 0 WHEN iou >= 0.5 THEN 1 ELSE (iou - 0.15) / 0.35 END, 6)::DOUBLE AS share, round(CASE WHEN iou <= 0.15 THEN 0 WHEN iou >= 0.5 THEN 1e6 ELSE pow((iou - 0.15) / 0.35, 2) END, 6)::DOUBLE AS cost,
  round((CASE WHEN ver >= 1.3 THEN 5 WHEN ver >= 1.1 THEN 9 WHEN ver >= 0.9 THEN 18 ELSE 35 END) * f, 6)::DOUBLE AS position, round(radians((CASE WHEN ver >= 1.3 THEN 0.6 WHEN ver >= 1.1 THEN 1.2 WHEN ver >= 0.9 THEN 2.5 ELSE 5 END) * f), 6)::DOUBLE AS angle,
  CASE WHEN q / 30 >= sqrt(0.125) AND q / 30 < 0.63 THEN 0.5 ELSE 1.0 END::DOUBLE AS half, round(q * 0.3048 / 62.5, 6) AS note, CASE WHEN q / 7 BETWEEN 0.1 AND 6 THEN 1 ELSE 0 END AS plausible FROM w""",
    "place_figures": f"""WITH {_SHEETS}, p AS (SELECT *, -90 + q / 1000 AS lon, 40 + n / 1000 AS lat, l_linenumber % 4 AS turn, q * 1e-4 AS h FROM s),
g AS (SELECT *, 111320 * cos(radians(lat)) AS k FROM p), f AS (SELECT *, (-90 - lon) * k AS ax, (40 - lat) * 110540 AS ay, (-89.99 + 90) * k AS dx, 0.005 * 110540 AS dy FROM g),
z AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS c FROM f)
SELECT {_K}, round((lon + 90) * cos(radians(40)) * 111320, 3) AS x, round((lat - 40) * 111320, 3) AS y, round(2 * 500 / k * 1e6, 3) AS width, round(2 * 500 / 110540 * 1e6, 3) AS height, round(sqrt(pow(ax + c * dx, 2) + pow(ay + c * dy, 2)), 3) AS away,
  round(CASE turn WHEN 1 THEN 99 - n WHEN 3 THEN n ELSE q END, 3)::DOUBLE AS u, round(CASE turn WHEN 1 THEN q WHEN 3 THEN 59 - q ELSE n END, 3)::DOUBLE AS v, round(0.01 * h * 111320 * cos(radians(40 + h / 2)) * 110540 / 1000, 3) AS area,
  round(q + (30 - 20) / n * sin(t) + (10 - 50) / n * cos(t), 3) AS east, round(n + (30 - 20) / n * cos(t) - (10 - 50) / n * sin(t), 3) AS north, round(3958.8 * {_HAV.format(a="40", b="lat", c="-90", d="lon")} * 1000, 3) AS miles FROM z""",
    "crossing_counts": "SELECT l_orderkey, (count(*) FILTER (l_returnflag = 'N'))::INT AS inliers, (count(DISTINCT l_partkey) FILTER (l_returnflag = 'N'))::INT AS streets, count(*) FILTER (l_returnflag = 'N') AS noted, 1 AS fewer FROM lineitem GROUP BY l_orderkey",
}
