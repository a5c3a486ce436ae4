"""Joins of labels, pages and annotations: control points at crossings, features by place, keys with a fallback, edges against truth, items against files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import documents as docs, geo, keys
from plumbline.operators import spatial
from plumbline.session import kept, table


def control_points(labels: DataFrame, crossings: DataFrame, reach: float = 3.0) -> DataFrame:
    """(sheet, a, b, x, y, lon, lat, apart): pixels at which two labels (sheet, key, street, x, y, dir) of crossing streets (a, b, lon, lat) would cross, with the crossing's place.

    Labels whose lines are nearly parallel, or cross too far from them, make none.
    """
    side = lambda p: labels.select("sheet", *[F.col(c).alias(f"{c}_{p}") for c in ("key", "street", "x", "y", "dir")])
    both = crossings.select(F.col("a").alias("street_a"), F.col("b").alias("street_b"), "lon", "lat")
    met = side("a").join(both, "street_a").join(side("b"), ["sheet", "street_b"]).where("key_a <> key_b")
    at = geo.line_crossing(F.col("x_a"), F.col("y_a"), F.col("dir_a"), F.col("x_b"), F.col("y_b"), F.col("dir_b"), reach)
    found = met.withColumn("at", at).where("at IS NOT NULL")
    return found.select("sheet", F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.col("street_a"), F.col("street_b"), "at.x", "at.y", "lon", "lat", F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")).alias("apart"))


def closest_of_each(points: DataFrame) -> DataFrame:
    """Of control points of one place and pair of streets the one whose labels are closest; of equals the least keys."""
    w = Window.partitionBy("sheet", "street_a", "street_b", "lon", "lat").orderBy("apart", "a", "b")
    return points.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def corridor(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """(key): features (key, x0, y0, x1, y1) that come within a radius of some point (id, x, y), on a plane of metres."""
    return spatial.near_segments(points, segments, radius_m).select("key").distinct()


def in_rectangles(vertices: DataFrame, boxes: DataFrame) -> DataFrame:
    """(key): features with a vertex (key, x, y) in some box (id, x0, y0, x1, y1)."""
    at = vertices.withColumn("id", F.monotonically_increasing_id()).select("id", "key", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    at = kept(at, "linkages-vertices")
    return at.join(spatial.overlapping_boxes(at.drop("key"), boxes).select("id").distinct(), "id", "left_semi").select("key").distinct()


def correspondences(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """(page, x, y): pages (page) and the places (text, x, y) on a key map at which their number is read."""
    numbered = detections.select(keys.page_number(F.col("text")).alias("number"), "x", "y").where("number IS NOT NULL")
    return pages.select("page", keys.page_number(F.col("page")).alias("number")).join(numbered, "number").select("page", "x", "y")


def inlier_pages(found: DataFrame, frames: DataFrame, model: tuple[float, float, float, float]) -> DataFrame:
    """(page): pages of which some place (page, x, y) falls, by a similarity, into one of its frames (page, ring)."""
    a, b, tx, ty = model
    u, v = a * F.col("x") + b * F.col("y") + tx, b * F.col("x") - a * F.col("y") + ty
    return found.join(frames, "page").where(geo.in_ring(F.col("ring"), u, v)).select("page").distinct()


def matching_keys(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page, key): keys (key) that a page's name stands for: its own, or else all of its number."""
    own = pages.select("page", keys.page_key(F.col("page")).alias("own"))
    exact = own.join(known.withColumnRenamed("key", "own"), "own").select("page", F.col("own").alias("key"))
    family = known.select("key", keys.key_stem(F.col("key")).alias("stem"))
    rest = own.join(exact.select("page"), "page", "left_anti").withColumn("stem", keys.key_stem(F.col("own"))).join(family, "stem").select("page", "key")
    return exact.union(rest)


def scored_edges(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (correct, wrong, unknown, truth, recovered) of edges (a, b) against true ones: unknown are those of pages that the truth doesn't know."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, real = pair(found), pair(truth)
    known = real.select("a").union(real.select("b")).distinct()
    hit = edges.join(real.withColumn("hit", F.lit(True)), ["a", "b"], "left")
    both = hit.join(known.withColumn("ka", F.lit(True)), "a", "left").join(known.select(F.col("a").alias("b"), F.lit(True).alias("kb")), "b", "left")
    seen = F.col("ka") & F.col("kb")
    counts = both.agg(F.count_if(F.col("hit")).alias("correct"), F.count_if(F.col("hit").isNull() & seen).alias("wrong"), F.count_if(F.col("hit").isNull() & seen.isNull()).alias("unknown"))
    return counts.crossJoin(real.agg(F.count("*").alias("truth"))).withColumn("recovered", F.when(F.col("truth") > 0, F.col("correct") / F.col("truth")).otherwise(0.0))  # both have one row


def rewritten_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """(id, page, path, skipped): annotations (id, source, label, metadata) with the local image (page, path) that they show, or why there is none."""
    page = keys.service_page_key(F.col("source"), F.coalesce("label", F.lit("")))
    panel = panel_index(F.col("id"), F.col("label"), F.col("metadata"))
    named = items.withColumn("sheet", keys.sheet_of(page)).withColumn("page", F.when(panel.isNotNull(), F.concat(keys.sheet_of(page), F.lit("__"), panel)).otherwise(keys.sheet_of(page)))
    found = named.join(files.select("page", "path"), "page", "left").join(files.select(F.col("page").alias("sheet"), F.col("path").alias("sheet_path")), "sheet", "left")
    why = F.when(F.col("sheet") == "", "no page key").when(F.coalesce("path", "sheet_path").isNull(), "no image")
    return found.select("id", "page", F.coalesce("path", "sheet_path").alias("path"), why.alias("skipped"))


def panel_index(item_id: Column, label: Column, metadata: Column) -> Column:
    """The panel an annotation shows: by its id, or by its label's [N] where it isn't our own output."""
    number = lambda c, p: F.regexp_extract(F.coalesce(c, F.lit("")), p, 1).try_cast("int")
    return F.coalesce(number(item_id, r"__(\d+)/"), F.when(~docs.is_own_output(metadata), number(label, r"\[(\d+)\]$")))


def item_stats(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(index, page, rmse): statistics (page, rmse) at the places of the items (index, page) they are about."""
    return pages.join(rows, "page").select("index", "page", "rmse")


def footprints(items: DataFrame) -> DataFrame:
    """(id, ring of [lon, lat]): sheets (id, width, height, affine) mapped to the ground by their corners."""
    corner = lambda x, y: F.array(*geo.apply_affine(F.col("affine"), x, y))
    w, h, o = F.col("width"), F.col("height"), F.lit(0.0)
    return items.where("affine IS NOT NULL").select("id", F.array(corner(o, o), corner(w, o), corner(w, h), corner(o, h)).alias("ring"))


def metre_rings(rings: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Rings (id, ring of [lon, lat]) on a plane of metres about a place."""
    return rings.select("id", F.transform("ring", lambda p: F.array(*geo.local_xy(p[0], p[1], F.lit(lon0), F.lit(lat0)))).alias("ring"))


def turned_off(poses: DataFrame, limit: float) -> DataFrame:
    """(volume, page, off, outlier): degrees that poses (volume, page, theta) are off their volume's mean direction, up to quarter turns."""
    angle = F.radians("theta")
    mean = poses.groupBy("volume").agg(F.degrees(F.atan2(F.sum(F.sin(angle * 4)), F.sum(F.cos(angle * 4)))).alias("mean4"))
    off = F.abs(F.pmod(F.col("theta") - F.col("mean4") / 4 + 45, F.lit(90.0)) - 45)
    return poses.join(mean, "volume").select("volume", "page", off.alias("off"), (off > limit).alias("outlier"))


def truth_metrics(rows: DataFrame) -> DataFrame:
    """(volume, n, mean, median, by_page) of errors (volume, page, rmse)."""
    known = rows.where("rmse IS NOT NULL")
    entries = F.sort_array(F.collect_list(F.struct("page", F.round("rmse", 1).alias("rmse"))))
    return known.groupBy("volume").agg(F.count("*").alias("n"), F.avg("rmse").alias("mean"), F.percentile("rmse", 0.5).alias("median"), F.map_from_entries(entries).alias("by_page"))


def key_map_union(sheets: DataFrame, gone: DataFrame) -> DataFrame:
    """(volume, key, x, y): places of keys on all of a volume's key maps (volume, sheet, key, x, y) but those gone (volume, sheet)."""
    return sheets.join(gone, ["volume", "sheet"], "left_anti").select("volume", "key", "x", "y")


def search_radius(places: DataFrame) -> DataFrame:
    """(volume, radius): twice the median distance of a key's mean place (volume, key, lon, lat) to the nearest other; 1000 for fewer than two keys."""
    mean = places.groupBy("volume", "key").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    other = mean.select("volume", F.col("key").alias("k2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    near = mean.join(other, "volume").where("key <> k2").groupBy("volume", "key").agg(F.min(geo.meters_between(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).alias("d"))
    radius = near.groupBy("volume").agg((2 * F.percentile("d", 0.5)).alias("radius"))
    return places.select("volume").distinct().join(radius, "volume", "left").select("volume", F.coalesce("radius", F.lit(1000.0)).alias("radius"))


def edge_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of customers' and suppliers' nations against those of nations of one region."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = joined.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.avg("l_quantity").alias("size")).where("size >= 25.5")
    nation = table(spark, sf_dir, "nation").where("n_regionkey > 0")
    other = nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return scored_edges(found, nation.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(other, "n_regionkey").where("a < b")).select("correct", "wrong", "unknown", "truth", F.round("recovered", 6).alias("recovered"))


def page_key_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as page names, some lettered, against parts' keys."""
    pages = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey") % 3000, F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("")).alias("page")).distinct()
    known = table(spark, sf_dir, "part").select(F.concat("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "A").when(F.col("p_partkey") % 3 == 1, "B").otherwise("")).alias("key"))
    return matching_keys(pages, known)


def volume_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("volume"), "s_suppkey", (-90 + F.col("s_suppkey") * 37 % 1000 / 1000).alias("lon"), (40 + F.col("s_suppkey") * 91 % 1000 / 1000).alias("lat"))
    return search_radius(places.withColumnRenamed("s_suppkey", "key")).select("volume", F.round("radius", 3).alias("radius"))


def nation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("volume"), F.col("s_suppkey").alias("page"), F.abs("s_acctbal").alias("rmse"))
    return truth_metrics(rows).select("volume", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.size("by_page").alias("pages"))


QUERIES = {f.__name__: f for f in (edge_truth, page_key_matches, volume_radius, nation_metrics)}
_D = "sqrt(pow((a.lon - b.lon) * 111320 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((a.lat - b.lat) * 110540, 2))"
ORACLES = {
    "edge_truth": """WITH e AS (SELECT c_nationkey AS x, s_nationkey AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING avg(l_quantity) >= 25.5),
f AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM e), n AS (SELECT * FROM nation WHERE n_regionkey > 0), t AS (SELECT p.n_nationkey AS a, q.n_nationkey AS b FROM n p JOIN n q ON p.n_regionkey = q.n_regionkey AND p.n_nationkey < q.n_nationkey),
k AS (SELECT a AS v FROM t UNION SELECT b FROM t), r AS (SELECT t.a IS NOT NULL AS hit, f.a IN (SELECT v FROM k) AND f.b IN (SELECT v FROM k) AS known FROM f LEFT JOIN t ON f.a = t.a AND f.b = t.b)
SELECT count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit AND known) AS wrong, count(*) FILTER (NOT known) AS unknown, (SELECT count(*) FROM t) AS truth, round(count(*) FILTER (hit) / (SELECT count(*) FROM t), 6) AS recovered FROM r""",
    "page_key_matches": """WITH p AS (SELECT DISTINCT o_orderkey % 3000 AS n, o_orderkey % 2 = 0 AS a FROM orders), k AS (SELECT p_partkey AS n, p_partkey || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS key FROM part)
SELECT 'p' || p.n || CASE WHEN a THEN 'a' ELSE '' END AS page, key FROM p JOIN k ON p.n = k.n""",
    "volume_radius": f"""WITH p AS (SELECT s_nationkey AS volume, s_suppkey AS key, -90 + s_suppkey * 37 % 1000 / 1000 AS lon, 40 + s_suppkey * 91 % 1000 / 1000 AS lat FROM supplier), d AS (SELECT a.volume, a.key, min({_D}) AS d FROM p a JOIN p b ON a.volume = b.volume AND a.key <> b.key GROUP BY 1, 2),
m AS (SELECT volume, 2 * median(d) AS radius FROM d GROUP BY volume) SELECT v.volume, round(coalesce(radius, 1000.0), 3) AS radius FROM (SELECT DISTINCT volume FROM p) v LEFT JOIN m USING (volume)""",
    "nation_metrics": "SELECT s_nationkey AS volume, count(*) AS n, round(avg(abs(s_acctbal)), 4) AS mean, round(median(abs(s_acctbal)), 4) AS median, count(*)::INT AS pages FROM supplier GROUP BY 1",
}
