"""Queries that apply the scalar functions to the driver's tables, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import geo, keys
from plumbline.session import table


def _lines(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *columns)


def edge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(geo.edge_class(F.col("l_quantity") / 50, F.col("l_linenumber") / 7).alias("edge"))
    return found.groupBy("edge").agg(F.count("*").alias("n"))


def flat_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each order's lines from a fixed point, in the flat frame."""
    c = F.col
    return _lines(spark, sf_dir, F.round(geo.meters_between(c("l_discount"), 40 + c("l_tax"), F.lit(0.05), F.lit(40.0) + c("l_quantity") / 1000), 3).alias("metres"))


def bearing_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity") * 37, F.col("l_suppkey") * 11
    wrapped, axis = geo.wrap_degrees(a - b), geo.axis_difference(a, b)
    fold = geo.folded_log2_distance(F.col("l_quantity") / 8, F.col("l_linenumber") / 4)
    return _lines(spark, sf_dir, wrapped.alias("wrapped"), axis.alias("axis"), fold.alias("fold"), geo.is_scale_outlier(F.col("l_quantity") / 25).cast("int").alias("outlier"))


def affine_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point through an affine composed with a second, and back by the inverse."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    m, k = geo.affine(q, 1, n, -1, q + 1, 3), geo.affine(2, 0, 1, 0, 2, -1)
    x, y = geo.apply_affine(geo.compose(m, k), F.lit(2.0), F.lit(5.0))
    lines = _lines(spark, sf_dir, m.alias("m"), x.alias("x"), y.alias("y"))
    back_x, back_y = geo.apply_affine(geo.invert_affine(F.col("m")), F.col("x"), F.col("y"))
    return lines.select("l_orderkey", "l_linenumber", "x", "y", F.round(back_x, 6).alias("back_x"), F.round(back_y, 6).alias("back_y"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and overlap of each line's box with the box of fixed place."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    a, b = (x, y, x + 10, y + 4), tuple(map(F.lit, (20.0, 3.0, 30.0, 7.0)))
    return _lines(spark, sf_dir, F.round(geo.box_gap(a, b), 6).alias("gap"), F.round(geo.box_iou(a, b), 6).alias("iou"))


def crossing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines along two axes through (quantity, 0) and (0, line) cross, within reach: the diagonal case."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    at = geo.line_crossing(q, F.lit(0.0), F.lit(0.0), F.lit(0.0), n, F.radians(F.lit(45.0)))
    return _lines(spark, sf_dir, F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y")).where("x IS NOT NULL")


def panel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("l_orderkey"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("__"), F.col("l_linenumber"))).otherwise(F.lit("")))
    return _lines(spark, sf_dir).select(key.alias("k")).groupBy(keys.sheet_of(F.col("k")).alias("sheet")).agg(F.max(keys.split_index(F.col("k"))).alias("last_panel"), F.count("*").alias("n"))


def spec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by a spec made from each part's size: a range, a single page and a lettered one."""
    size = F.col("p_size")
    pages = table(spark, sf_dir, "part").select("p_partkey", F.explode(keys.page_spec(F.format_string("%d-%d, %d,%da", size + 3, size, size + 7, size))).alias("page"))
    return pages.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("page").alias("least"), F.max("page").alias("greatest"))


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(keys.matches_query(F.col("text"), "the, und,,LES ")).select("doc_id")


QUERIES = {f.__name__: f for f in (edge_classes, flat_distances, bearing_folds, affine_round_trip, box_overlaps, crossing_lines, panel_keys, spec_pages, text_filter)}
_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
ORACLES = {
    "edge_classes": """SELECT coalesce(nullif(CASE WHEN y < 0.25 THEN 'T' ELSE '' END || CASE WHEN y > 0.75 THEN 'B' ELSE '' END || CASE WHEN x < 0.25 THEN 'L' ELSE '' END || CASE WHEN x > 0.75 THEN 'R' ELSE '' END, ''), 'center') AS edge, count(*) AS n
FROM (SELECT l_quantity / 50 AS x, l_linenumber / 7 AS y FROM lineitem) GROUP BY 1""",
    "flat_distances": f"""SELECT {_KEY}, round(sqrt(pow((l_discount - 0.05) * 111320 * cos(radians((40 + l_tax + 40 + l_quantity / 1000) / 2)), 2) + pow((40 + l_tax - (40 + l_quantity / 1000)) * 110540, 2)), 3) AS metres FROM lineitem""",
    "bearing_folds": f"""SELECT {_KEY}, (((d + 180) % 360) + 360) % 360 - 180 AS wrapped, (((d + 90) % 180) + 180) % 180 - 90 AS axis, least(f, 1 - f) AS fold,
  CASE WHEN r BETWEEN 0.75 AND 1.25 OR r BETWEEN 0.4 AND 0.6 OR r BETWEEN 1.8 AND 2.2 THEN 0 ELSE 1 END AS outlier
FROM (SELECT *, l_quantity * 37 - l_suppkey * 11 AS d, abs(l_quantity / 8 - l_linenumber / 4) % 1 AS f, l_quantity / 25 AS r FROM lineitem)""",
    "affine_round_trip": """SELECT l_orderkey, l_linenumber, l_quantity * 5 + 9 + l_linenumber AS x, -5 + (l_quantity + 1) * 9 + 3 AS y, 5.0::DOUBLE AS back_x, 9.0::DOUBLE AS back_y FROM lineitem""",
    "box_overlaps": f"""SELECT {_KEY}, round(sqrt(pow(greatest(0, greatest(x, 20) - least(x + 10, 30)), 2) + pow(greatest(0, greatest(y, 3) - least(y + 4, 7)), 2)), 6) AS gap, round(c / (80 - c), 6) AS iou
FROM (SELECT *, greatest(0, least(x + 10, 30) - greatest(x, 20)) * greatest(0, least(y + 4, 7) - greatest(y, 3)) AS c FROM (SELECT *, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem))""",
    "crossing_lines": f"""SELECT {_KEY}, -l_linenumber::DOUBLE AS x, 0.0::DOUBLE AS y FROM lineitem
WHERE l_quantity + l_linenumber <= 3 * sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) AND sqrt(2.0) * l_linenumber <= 3 * sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)""",
    "panel_keys": "SELECT 'p' || l_orderkey AS sheet, max(CASE WHEN l_linenumber > 1 THEN l_linenumber END) AS last_panel, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "spec_pages": """WITH k AS (SELECT p_partkey, unnest([(p_size)::VARCHAR, (p_size + 1)::VARCHAR, (p_size + 2)::VARCHAR, (p_size + 3)::VARCHAR, (p_size + 7)::VARCHAR, p_size || 'A']) AS page FROM part)
SELECT p_partkey, count(DISTINCT page) AS n, min(page) AS least, max(page) AS greatest FROM k GROUP BY p_partkey""",
    "text_filter": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bthe\b|\bund\b|\bles\b')",
}
