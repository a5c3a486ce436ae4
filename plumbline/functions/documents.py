"""Fields of pose sidecars, annotations and GeoJSON as column expressions over their structs (see sources.sidecars for the schemas)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The metadata labels by which our own annotations are known; the transform of annotations that name none; pixels within which crossings are one.
OWN_LABELS, DEFAULT_TRANSFORM, SAME_CROSSING = ("streets", "intersections"), "polynomial", 60.0
#: OSM highways that are no streets, and services that are.
NO_STREETS = ("construction", "corridor", "cycleway", "elevator", "footway", "motorway", "motorway_link", "path", "pedestrian", "proposed", "steps", "track")
SERVICES = ("alley",)


def metadata_value(metadata: Column, label: str) -> Column:
    """The value of the first entry with this label; null without one."""
    return F.get(F.filter(metadata, lambda m: m["label"] == label), F.lit(0))["value"]


def metadata_int(metadata: Column, label: str) -> Column:
    return F.trim(metadata_value(metadata, label)).try_cast("long")


def metadata_float(metadata: Column, label: str) -> Column:
    return F.trim(metadata_value(metadata, label)).try_cast("double")


def control_points(features: Column) -> Column:
    """Structs (px, py, lon, lat) of an annotation's features."""
    at = lambda f: (f["properties"]["resourceCoords"], f["geometry"]["coordinates"])
    made = lambda p, w: F.struct(p[0].alias("px"), p[1].alias("py"), w[0].alias("lon"), w[1].alias("lat"))
    return F.transform(features, lambda f: made(*at(f)))


def transform_type(body: Column) -> Column:
    return F.coalesce(body["transformation"]["type"], F.lit(DEFAULT_TRANSFORM))


def is_own_output(metadata: Column) -> Column:
    return F.coalesce(F.exists(metadata, lambda m: F.coalesce(m["label"].isin(*OWN_LABELS), F.lit(False))), F.lit(False))


def status(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("fitted"))


def internally_valid(corners: Column, value: Column) -> Column:
    """Whether the channel that wrote a pose stands behind it."""
    return (F.coalesce(F.size(corners), F.lit(0)) > 0) & (status(value) == "fitted")


def rejected_poses(rejected: Column) -> Column:
    return F.coalesce(rejected, F.array().cast("array<string>"))


def inlier_count(crossings: Column) -> Column:
    return F.coalesce(F.size(F.filter(crossings, lambda c: F.coalesce(c["inlier"], F.lit(False)))), F.lit(0))


def inlier_streets(streets: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(F.transform(F.filter(streets, lambda s: F.coalesce(s["inlier"], F.lit(False))), lambda s: s["street"]))), F.lit(0))


def effective_crossings(crossings: Column) -> Column:
    """Inlier crossings that lie apart from every one counted before them."""
    far = lambda kept, c: F.forall(kept, lambda k: F.hypot(c["x"] - k["x"], c["y"] - k["y"]) >= SAME_CROSSING)
    points = F.transform(F.filter(crossings, lambda c: F.coalesce(c["inlier"], F.lit(False))), lambda c: F.struct(c["x"].cast("double").alias("x"), c["y"].cast("double").alias("y")))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.coalesce(F.size(F.aggregate(points, none, lambda kept, c: F.when(far(kept, c), F.concat(kept, F.array(c))).otherwise(kept))), F.lit(0))


def georef_metadata(streets: Column, crossings: Column, canvas: Column | None = None) -> Column:
    """Metadata entries (label, value) of a pose: its inlier streets and crossings, and the panel's place on its sheet (x, y, w, h)."""
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    found = F.array(entry("streets", inlier_streets(streets)), entry("intersections", inlier_count(crossings)))
    if canvas is None:
        return found
    place = F.array(*[entry(f"split_canvas_{k}", canvas[k]) for k in "xywh"])
    return F.concat(found, F.when(canvas.isNotNull(), place).otherwise(F.slice(place, 1, 0)))


def vertices(lines: Column) -> Column:
    """All points of a geometry given as an array of lines or rings."""
    return F.flatten(lines)


def segments(lines: Column) -> Column:
    """Structs (a, b) of following points of each line."""
    of = lambda line: F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(lines, of))


def geometry_lines(kind: Column, json: Column) -> Column:
    """A GeoJSON geometry's coordinates (as JSON) as an array of lines; null for geometries that have none."""
    of = lambda depth: F.from_json(json, "array<" * depth + "double" + ">" * depth)
    flat = F.when(kind == "Point", F.array(F.array(of(1)))).when(kind.isin("LineString", "MultiPoint"), F.array(of(2))).when(kind.isin("MultiLineString", "Polygon"), of(3))
    return flat.when(kind == "MultiPolygon", F.flatten(of(4)))


def bbox(lines: Column) -> Column:
    """Struct (west, east, south, north) of lines; null without points."""
    axis = lambda i: F.transform(vertices(lines), lambda p: p[i])
    made = F.struct(F.array_min(axis(0)).alias("west"), F.array_max(axis(0)).alias("east"), F.array_min(axis(1)).alias("south"), F.array_max(axis(1)).alias("north"))
    return F.when(F.size(vertices(lines)) > 0, made)


def should_drop(highway: Column, service: Column) -> Column:
    """Whether an OSM way is no street to be named on a sheet."""
    odd = (highway == "service") & service.isNotNull() & ~service.isin(*SERVICES)
    return F.coalesce(highway.isin(*NO_STREETS) | odd, F.lit(False))


def latest_records(lines: DataFrame, schema: str, key: str = "target") -> DataFrame:
    """Records of JSON lines (file, position, line): of one target the last line counts, and a line that is no record is passed over."""
    rows = lines.select("file", "position", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r")).select("file", "position", "r.*").where(F.col(key).isNotNull())
    last = F.row_number().over(Window.partitionBy("file", key).orderBy(F.desc("position")))
    return rows.withColumn("last", last).where("last = 1").drop("last", "position")


def dropped_kind(json: Column) -> Column:
    """What a JSON document is, by its fields: records, poses, detections, boxes, annotations, panels, features, adjacency or unknown."""
    has = lambda path: F.get_json_object(json, path).isNotNull()
    kinds = [("$.adjacency", "adjacency"), ("$.panels", "panels"), ("$.boxes", "boxes"), ("$.corners", "pose"), ("$.streets", "detections"), ("$.items", "annotations"), ("$.features", "features"), ("$.candidates", "records")]
    found = F
    for path, kind in kinds:
        found = found.when(has(path), kind)
    return found.otherwise("unknown")


def run_record(source: Column, params: Column) -> Column:
    """JSON of a run: its source, its parameters and the time in UTC."""
    return F.to_json(F.struct(source.alias("source"), params.alias("params"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))


def svg_polygon(ring: Column, places: int = 1) -> Column:
    """A ring of [x, y] as the polygon of an SVG selector."""
    points = F.array_join(F.transform(ring, lambda p: F.concat_ws(",", F.round(p[0], places), F.round(p[1], places))), " ")
    return F.concat(F.lit('<svg><polygon points="'), points, F.lit('" /></svg>'))


def embedded_json(html: Column, key: str) -> Column:
    """The JSON object or array that follows a key in a page; null without one. Brackets inside strings don't count."""
    start = F.regexp_extract(html, f'(?s)"{key}"\\s*:\\s*([\\[{{].*)$', 1)
    body = F.regexp_replace(start, r'\\.', "__")  # escaped signs end no string
    bare = F.regexp_replace(body, r'"[^"]*"', "")
    step = lambda s, c: F.when(s["done"], s).otherwise(_stepped(s, c))

    def _stepped(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("done"))

    # Signs outside of strings up to the end, then the same number of them in the text.
    closing = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")), step)
    outside = F.aggregate(
        F.split(body, ""), F.struct(F.lit(0).alias("seen"), F.lit(0).alias("n"), F.lit(False).alias("quoted")),
        lambda s, c: F.when(s["seen"] >= closing["n"], s).otherwise(F.struct((s["seen"] + F.when((c == '"') | s["quoted"], 0).otherwise(1)).alias("seen"), (s["n"] + 1).alias("n"), (s["quoted"] != (c == '"')).alias("quoted"))),
    )
    return F.when((start != "") & closing["done"], F.substring(start, F.lit(1), outside["n"]))


def jpeg_size(content: Column) -> Column:
    """Struct (width, height) of a JPEG by its frame header; null where there is none. Segments are skipped by their lengths."""
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(_jpeg_sizes, "width int, height int")(content)


def _jpeg_sizes(contents):
    import pandas as pd

    return pd.DataFrame([_jpeg_size(c) for c in contents], columns=["width", "height"]).astype("Int32")


def _jpeg_size(data: bytes | None) -> tuple[int | None, int | None]:
    at = 2 if data and data[:2] == b"\xff\xd8" else len(data or b"")
    while data and at + 4 <= len(data) and data[at] == 0xFF:
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= data[at + 1] <= 0xC3 and at + 9 <= len(data):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + length
    return None, None
