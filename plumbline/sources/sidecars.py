"""Sidecar files as tables: one row per document, or one per element where that is what queries need.

Readers take a folder or a pattern and state their schema, so nothing is inferred by reading the files
twice. Where one page has several documents the first pattern wins; of a page's JSON lines the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import documents as tags, keys

RING = "ARRAY<ARRAY<DOUBLE>>"
STREET = f"STRUCT<polygon: {RING}, text: STRING, confidence: DOUBLE, angle: INT, dir_pix: DOUBLE, long_side: DOUBLE, short_side: DOUBLE, ignore: BOOLEAN, hint: BOOLEAN, fallback: BOOLEAN>"
SCHEMAS = {
    "panels": f"image STRING, width DOUBLE, height DOUBLE, manual BOOLEAN, panels ARRAY<{RING}>, labels ARRAY<STRING>",
    "streets": f"width INT, height INT, timestamp STRING, command ARRAY<STRING>, streets ARRAY<{STREET}>",
    "georef": f"width INT, height INT, corners {RING}, status STRING, status_detail MAP<STRING, STRING>, printed_scale STRUCT<ft_per_inch: INT, confidence: DOUBLE>, rejected ARRAY<STRING>",
    "adjacency": "pages MAP<STRING, STRUCT<number: INT, width: INT, height: INT>>, adjacency ARRAY<ARRAY<STRING>>, one_sided ARRAY<ARRAY<STRING>>",
    "labels": "width INT, height INT, labels ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, text: STRING>>",
    "osm": "elements ARRAY<STRUCT<id: BIGINT, type: STRING, lat: DOUBLE, lon: DOUBLE, nodes: ARRAY<BIGINT>, members: ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>, tags: MAP<STRING, STRING>>>",
    "history": "epoch INT, loss DOUBLE, val_clean DOUBLE, val_corrupted DOUBLE",
}


def page_of(path: Column) -> Column:
    """The name of a file without its folders and all its extensions."""
    return F.substring_index(F.url_decode(F.element_at(F.split(path, "/"), -1)), ".", 1)


def documents(spark: SparkSession, kind: str, *patterns: str) -> DataFrame:
    """(page, path, ...) for JSON documents of a kind; a page takes its document from the first pattern that has one."""
    found = None
    for rank, pattern in enumerate(patterns):
        rows = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("path"), F.lit(rank).alias("rank"))
        found = rows if found is None else found.unionByName(rows)
    found = found.withColumn("page", page_of(F.col("path")))
    if len(patterns) > 1:
        first = Window.partitionBy("page")
        found = found.withColumn("best", F.min("rank").over(first)).where("rank = best").drop("best")
    return found.drop("rank")


def detections(spark: SparkSession, *patterns: str) -> DataFrame:
    """(page, i, polygon, text, confidence, ...): a row per street label; a file may hold the list alone."""
    wrapped = documents(spark, "streets", *patterns).where("streets IS NOT NULL").select("page", F.posexplode("streets").alias("i", "s"))
    bare = None
    for pattern in patterns:
        lists = spark.read.text(pattern, wholetext=True).where(F.ltrim("value").startswith("[")).select(page_of(F.col("_metadata.file_path")).alias("page"), F.from_json("value", f"ARRAY<{STREET}>").alias("l"))
        lists = lists.select("page", F.posexplode("l").alias("i", "s"))
        bare = lists if bare is None else bare.union(lists)
    return wrapped.union(bare).select("page", "i", "s.*")


def panels(spark: SparkSession, pattern: str) -> DataFrame:
    """(page, panel from 1, ring, width, height)."""
    found = documents(spark, "panels", pattern).select("page", "width", "height", F.posexplode("panels").alias("at", "ring"))
    return found.select("page", (F.col("at") + 1).alias("panel"), "ring", "width", "height")


def centerlines(spark: SparkSession, pattern: str) -> DataFrame:
    """(street_name, line, ring of [lon, lat]): LineStrings, and the parts of MultiLineStrings, as lines of their own."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<street_name: STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(pattern).select(F.posexplode("features").alias("line", "f")).select("line", "f.properties.street_name", "f.geometry.*")
    parts = F.when(F.col("type") == "MultiLineString", F.from_json("coordinates", f"ARRAY<{RING}>")).when(F.col("type") == "LineString", F.array(F.from_json("coordinates", RING)))
    return each.select("street_name", "line", F.explode(parts).alias("ring"))


def newest_lines(spark: SparkSession, pattern: str, schema: str, page: str) -> DataFrame:
    """The last JSON line of each page; lines that don't parse (a cut last line) are left out. A file's lines keep their order by offset."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.select("path", "at", F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where(f"r._bad IS NULL AND r.{page} IS NOT NULL")
    return parsed.groupBy(F.col(f"r.{page}").alias("key")).agg(F.max_by("r", F.struct("path", "at")).alias("r")).select("r.*").drop("_bad")


def ways(spark: SparkSession, pattern: str) -> DataFrame:
    """(way, name, ring of [lon, lat]): named streets of an OSM file joined to their nodes; ways that are no streets, lack a node, or have under two are left out."""
    each = spark.read.schema(SCHEMAS["osm"]).option("multiLine", True).json(pattern).select(F.explode("elements").alias("e")).select("e.*")
    nodes = each.where("type = 'node' AND lon IS NOT NULL AND lat IS NOT NULL").select(F.col("id").alias("ref"), "lon", "lat")
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    named = each.where(F.col("type") == "way").where((F.coalesce(tag("name"), F.lit("")) != "") & ~tags.should_drop(tag("highway"), tag("service")))
    used = named.select(F.col("id").alias("way"), tag("name").alias("name"), F.size("nodes").alias("n"), F.posexplode("nodes").alias("at", "ref"))
    met = used.join(nodes.dropDuplicates(["ref"]), "ref").groupBy("way", "name", "n").agg(F.sort_array(F.collect_list(F.struct("at", "lon", "lat"))).alias("p"))
    return met.where("size(p) >= 2 AND size(p) = n").select("way", "name", F.transform("p", lambda p: F.array(p["lon"], p["lat"])).alias("ring"))


def annotations(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, label, width, height, points, panel): items of IIIF annotation pages; the panel comes from the id, else from a trailing [N]."""
    item = "STRUCT<id: STRING, label: STRING, target: STRUCT<source: STRUCT<id: STRING, width: INT, height: INT>, selector: STRUCT<value: STRING>>>"
    each = spark.read.schema(f"items ARRAY<{item}>").option("multiLine", True).json(pattern).select(F.explode("items").alias("i")).select("i.*")
    number = lambda c, p: F.regexp_extract(F.coalesce(c, F.lit("")), p, 1).try_cast("int")
    return each.select(
        "id", "label", "target.source.width", "target.source.height", keys.svg_points(F.col("target.selector.value")).alias("points"),
        F.coalesce(number(F.col("id"), r"__(\d+)/"), number(F.col("label"), r"\[(\d+)\]\s*$")).alias("panel"),
    )


def features(df: DataFrame, ring: str = "ring", kind: str = "Polygon") -> DataFrame:
    """(type, properties, geometry): rows as GeoJSON features: the ring as a closed Polygon, a LineString, or its first point; the other columns as properties."""
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.col(ring)).otherwise(F.concat(F.col(ring), F.slice(ring, 1, 1)))
    rest = [c for c in df.columns if c != ring]
    shape = {"Polygon": F.array(closed), "LineString": F.col(ring), "Point": F.element_at(ring, 1)}[kind]
    geometry = F.struct(F.lit(kind).alias("type"), shape.alias("coordinates"))
    return df.select(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))


def write_features(df: DataFrame, path: str, ring: str = "ring", kind: str = "Polygon") -> None:
    """Rows as GeoJSON features, a JSON line each."""
    features(df, ring, kind).write.json(path)


def scale_notes(labels: DataFrame) -> DataFrame:
    """(page, feet, confidence): the surest scale note among a page's labels (page, text, confidence)."""
    feet = keys.scale_note(F.col("text"), F.col("confidence"))
    noted = labels.withColumn("feet", feet).where("feet IS NOT NULL")
    return noted.groupBy("page").agg(F.max(F.struct("confidence", (-F.col("feet")).alias("less"), "feet")).alias("b")).select("page", "b.feet", "b.confidence")
