"""Sidecar readers, the feature sink and functions on rows of their own."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo, keys
from plumbline.sources import sidecars


def put(folder, name, doc):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))


def test_first_pattern_wins_even_without_a_pose(spark, tmp_path):
    put(tmp_path / "a", "p1.georef.json", {"width": 10, "height": 20, "corners": None, "status": "nofit"})
    put(tmp_path / "b", "p1.georef.json", {"width": 10, "height": 20, "corners": [[1, 2], [3, 4], [5, 6], [7, 8]]})
    put(tmp_path / "b", "p2.georef.json", {"width": 11, "height": 21, "corners": [[1, 2], [3, 4], [5, 6], [7, 8]], "other": 1})
    got = {r["page"]: (r["status"], r["corners"] is None) for r in sidecars.documents(spark, "georef", f"{tmp_path}/a/*.json", f"{tmp_path}/b/*.json").collect()}
    assert got == {"p1": ("nofit", True), "p2": (None, False)}


def test_detections_wrapped_or_bare(spark, tmp_path):
    label = {"polygon": [[0, 0], [1, 0], [1, 1], [0, 1]], "text": "MAIN ST", "confidence": 0.9}
    put(tmp_path / "d", "p1.streets.json", {"width": 5, "height": 5, "streets": [label, {"text": "50 FT. TO ONE INCH", "confidence": 0.5}]})
    put(tmp_path / "d", "p2.streets.json", [label])
    put(tmp_path / "d", "p3.streets.json", {"width": 5, "height": 5, "streets": []})
    rows = sidecars.detections(spark, f"{tmp_path}/d/*.json")
    assert sorted((r["page"], r["i"], r["text"]) for r in rows.collect()) == [("p1", 0, "MAIN ST"), ("p1", 1, "50 FT. TO ONE INCH"), ("p2", 0, "MAIN ST")]
    notes = rows.select("page", keys.scale_note(F.col("text"), F.col("confidence")).alias("ft")).where("ft IS NOT NULL").collect()
    assert [tuple(r) for r in notes] == [("p1", 50)]
    more = rows.select("page", "text", "confidence").union(spark.createDataFrame([("p1", "SCALE 100 FT. TO ONE INCH", 0.7), ("p1", "70 FT TO ONE INCH", 0.9)], "page string, text string, confidence double"))
    assert [tuple(r) for r in sidecars.scale_notes(more).collect()] == [("p1", 100, 0.7)]


def test_panels_centerlines_and_features(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4]]
    put(tmp_path / "p", "p9.panels.json", {"image": "p9.jpg", "width": 8, "height": 8.5, "panels": [square, square[:3]]})
    rows = sidecars.panels(spark, f"{tmp_path}/p/*.json")
    got = sorted((r["panel"], r["area"], round(r["c"], 6), r["inside"]) for r in rows.select("panel", geo.ring_area(F.col("ring")).alias("area"), geo.compactness(F.col("ring")).alias("c"), geo.in_ring(F.col("ring"), F.lit(1.0), F.lit(3.0)).alias("inside")).collect())
    assert got == [(1, 16.0, 0.785398, True), (2, 8.0, 0.539012, False)]
    sidecars.write_features(rows, f"file://{tmp_path}/out")
    back = spark.read.json(f"file://{tmp_path}/out").select("properties.panel", F.size(F.col("geometry.coordinates")[0]).alias("n")).collect()
    assert sorted(map(tuple, back)) == [(1, 5), (2, 4)]
    lines = {"features": [{"properties": {"street_name": "A"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}, {"properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]}}]}
    put(tmp_path / "c", "c.geojson", lines)
    assert sorted((r["line"], r["ring"][0][0]) for r in sidecars.centerlines(spark, f"{tmp_path}/c/*").collect()) == [(0, 1.0), (1, 1.0), (1, 5.0)]


def test_last_line_wins_and_cut_lines_go(spark, tmp_path):
    put(tmp_path / "l", "c.jsonl", '{"target": "p1", "margin": 1}\n{"target": "p2", "margin": 2}\n{"target": "p1", "margin": 3}\n\n{"target": "p2", "mar')
    got = sidecars.newest_lines(spark, f"{tmp_path}/l/*.jsonl", "target STRING, margin DOUBLE", "target").collect()
    assert sorted((r["target"], r["margin"]) for r in got) == [("p1", 3.0), ("p2", 2.0)]


def test_ways_and_annotations(spark, tmp_path):
    node = lambda i: {"type": "node", "id": i, "lon": i / 10, "lat": 1.0}
    way = lambda i, ns, **t: {"type": "way", "id": i, "nodes": ns, "tags": t}
    put(tmp_path / "o", "osm.json", {"elements": [node(1), node(2), way(7, [2, 1, 2], name="ELM"), way(8, [1, 2, 99], name="GONE"), way(9, [1, 2]), way(10, [1, 2], name="PATH", highway="footway"), way(11, [1, 2], name="YARD", highway="service", service="driveway")]})
    assert [(r["way"], r["name"], r["ring"]) for r in sidecars.ways(spark, f"{tmp_path}/o/*").collect()] == [(7, "ELM", [[0.2, 1.0], [0.1, 1.0], [0.2, 1.0]])]
    target = {"source": {"id": "s", "width": 5, "height": 6}, "selector": {"value": '<svg><polygon points="0,0 4,0 bad 4,4.5"/></svg>'}}
    put(tmp_path / "i", "a.json", {"items": [{"id": "x/p1__2/a", "label": "p1 [3]", "target": target}, {"id": "x/p2", "label": "p2 [4]", "target": target}, {"id": "x/p3", "target": target}]})
    got = sorted((r["id"], r["panel"], r["points"]) for r in sidecars.annotations(spark, f"{tmp_path}/i/*").collect())
    points = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.5]]
    assert got == [("x/p1__2/a", 2, points), ("x/p2", 4, points), ("x/p3", None, points)]


def test_page_specs(spark):
    rows = spark.createDataFrame([("8-5, 7, 10a,,12B, 9",), ("",), (None,)], "s string").select(keys.page_spec(F.col("s")).alias("k")).collect()
    assert [r["k"] for r in rows] == [["5", "6", "7", "8", "9", "10A", "12B"], [], None]
    with pytest.raises(Exception, match="invalid page token"):
        spark.createDataFrame([("x1",)], "s string").select(keys.page_spec(F.col("s"))).collect()
    order = spark.createDataFrame([("36",), ("35A",), ("key",), ("35",)], "k string").orderBy(keys.sort_key(F.col("k"))).collect()
    assert [r["k"] for r in order] == ["35", "35A", "36", "key"]


def test_folds_and_filters(spark):
    r = spark.range(1).select(
        geo.wrap_degrees(F.lit(-180.0)).alias("w"), geo.axis_difference(F.lit(10.0), F.lit(170.0)).alias("a"), geo.residual_bucket(F.lit(200.0)).alias("b"),
        keys.matches_query(F.lit("corner of O'Neil St."), " , o'neil").alias("m"), keys.matches_query(F.lit("Astor"), "st").alias("n"), keys.split_index(F.lit("p5__x")).alias("i"),
        geo.bilinear(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))]), F.lit(0.5), F.lit(0.25))[1].alias("y"),
    ).first()
    assert tuple(r) == (-180.0, 20.0, "poor", True, False, None, 0.5)
