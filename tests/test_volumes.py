"""Volumes, archives and label rules on small files and rows."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import labels
from plumbline.sources import volumes
from plumbline.streaming import stateful

JPEG = bytes.fromhex("ffd8ffe000040000ffc0001108") + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" + bytes(9)


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_pages(spark, tmp_path):
    for name in ("p1.jpg", "p2.jpg", "p2__1.jpg", "p2__2.jpg", "pa.jpg", "p0.jpg", "p12b.jpg"):
        (tmp_path / name).write_bytes(JPEG)
    every = volumes.images(spark, f"{tmp_path}/p1*.jpg", f"{tmp_path}/*.jpg")
    assert {(r["page"], r["rank"]) for r in every.collect()} == {("p1", 0), ("p12b", 0), ("p2", 1), ("p2__1", 1), ("p2__2", 1), ("pa", 1), ("p0", 1)}
    assert {r["page"] for r in volumes.list_pages(every).collect()} == {"p1", "p12b", "p2__1", "p2__2", "pa", "p0"}
    assert {r["page"] for r in volumes.whole_pages(every, rows(spark, "key string", ("0",))).collect()} == {"p1", "p2", "p12b"}
    assert {r["key"] for r in volumes.page_keys(every).collect()} == {"1", "2", "12B", "0"}
    assert {(r["page"], r["rank"]) for r in volumes.key_map_candidates(every).collect()} == {("pa", -1), ("p0", 0), ("p1", 1)}
    assert {(r["width"], r["height"]) for r in volumes.image_sizes(spark, f"{tmp_path}/*.jpg").collect()} == {(640, 480)}


def test_regions_and_indexes(spark, tmp_path):
    doc = {"width": 10, "height": 20, "corners": [[0, 40], [1, 40], [1, 38], [0, 38]], "regions": {"5": [[[0, 0], [10, 0], [10, 20]]]}}
    (tmp_path / "pa.keymap.json").write_text(json.dumps(doc))
    got = volumes.regions(spark, f"{tmp_path}/*.json").collect()
    assert [(r["page"], r["key"], r["ring"]) for r in got] == [("pa", "5", [[0.0, 40.0], [1.0, 40.0], [1.0, 38.0]])]
    canvas = lambda label, service, url: {"label": label, "images": [{"resource": {"@id": url, "width": 100, "height": 51, "service": {"@id": service}}}]}
    (tmp_path / "m.manifest").write_text(json.dumps({"label": "Vol", "sequences": [{"canvases": [canvas("a", "s:1950-0001", "x/full/pct:25/0"), canvas("b", "s:1950-0001", "x/full/full"), canvas("c", "s:covr", "x"), canvas("d", "s:covra", "x"), canvas("e", "s:covr", "x")]}]}))
    found = volumes.manifest_canvases(spark, f"{tmp_path}/*.manifest")
    assert [(r["label"], r["width"], r["height"]) for r in found.orderBy("position").limit(2).collect()] == [("Vol | a", 400, 204), ("Vol | b", 100, 51)]
    assert [r["page"] for r in volumes.download_targets(found, F.lit("out")).orderBy("position").collect()] == ["p1a", "p1b", "covrb", "covra", "covrc"]
    items = rows(spark, "volume long, page string, source string", (1, "p5", None), (1, "p1234567a", ""), (1, "p7", "s:x-0007"), (1, "px", None), (2, "p1", None), (2, "p2", "a:sb00020"), (3, "p1", "a-01"), (3, "p2", "b-02"), (3, "p3", None))
    assert {(r["volume"], r["page"], r["source"]) for r in volumes.filled_sources(items).collect()} >= {(1, "p5", "s:x-0005"), (1, "p1234567a", "s:x-1234567A"), (1, "px", None), (2, "p1", None), (3, "p3", None)}
    rings = volumes.panel_rings(rows(spark, "page string, panel int, ring array<array<double>>, width double, height double", ("p1", 1, [[1.0, 2.0]], 10.0, 10.0), ("p2", 1, [[1.0, 2.0]], 10.0, 10.0)), rows(spark, "page string, source_width double, source_height double", ("p1", 40.0, 20.0)))
    assert {r["page"]: r["ring"] for r in rings.collect()} == {"p1": [[4.0, 4.0]], "p2": [[1.0, 2.0]]}


def test_annotations(spark):
    point = [(1.0, 2.0, -90.0, 40.0)]
    df = rows(spark, "page string, points array<struct<px:double,py:double,lon:double,lat:double>>, mask array<array<double>>", ("p5__2", point, None), ("p6", point, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]))
    meta = F.array(F.struct(F.lit("streets").alias("label"), F.lit("3").alias("value")))
    made = df.select(F.to_json(volumes.annotation(F.col("page"), F.lit("http://s/1/info.json"), F.lit("L"), F.lit(100), F.lit(50), F.col("points"), F.col("mask"), meta)).alias("j")).collect()
    a, b = (json.loads(r["j"]) for r in made)
    assert a["id"] == "http://s/1__2/georef" and a["target"]["selector"]["value"] == '<svg><polygon points="0.0,50.0 0.0,0.0 100.0,0.0 100.0,50.0 0.0,50.0" /></svg>'
    assert b["target"]["selector"]["value"].count(",") == 3 and b["body"]["features"][0]["geometry"]["coordinates"] == [-90.0, 40.0]
    placed = df.select(volumes.panel_points(F.col("points"), F.struct(*[F.lit(v).alias(k) for k, v in zip("xywh", (10.0, 20.0, 50.0, 40.0))]), F.lit(100.0), F.lit(80.0)).alias("p")).first()["p"][0]
    assert (placed["px"], placed["py"]) == (10.5, 21.0)


def test_records(spark):
    pages = rows(spark, "page string", ("p1",), ("p2",), ("p2",))
    chosen = rows(spark, "page string, corners array<array<double>>", ("p1", [[0.0, 1.0]]))
    assert {(r["page"], r["status"]) for r in volumes.published(pages, chosen).collect()} == {("p1", "fitted"), ("p2", "unplaced")}
    poses = rows(spark, "page string, status string, status_detail map<string,string>, rejected array<string>", ("p1", None, {"a": "1", "b": "2"}, None), ("p2", "outlier", None, ["x"]))
    after = volumes.demoted(poses, rows(spark, "page string, verdict string, detail map<string,string>", ("p1", "misscale", {"b": "9"})))
    assert {r["page"]: (r["status"], r["status_detail"]) for r in after.collect()} == {"p1": ("misscale", {"a": "1", "b": "9"}), "p2": ("outlier", None)}
    more = volumes.with_rejected(poses, rows(spark, "page string, pose string", ("p2", "z"), ("p2", "y")))
    assert {r["page"]: r["rejected"] for r in more.collect()} == {"p1": [], "p2": ["x", "y", "z"]}
    both = volumes.channel_records(rows(spark, "target string, n int", ("p1", 1)), rows(spark, "target string, m int", ("p2", 2)))
    assert {(r["page"], r["snap"] is None, r["street"] is None) for r in both.collect()} == {("p1", False, True), ("p2", True, False)}
    report = rows(spark, "line string", ("p12 34.5ft -0.3 1.02",), ("mean 3 4 5",), ("p13 missing",))
    assert [tuple(r) for r in volumes.parse_compare(report).collect()] == [("p12", 34.5, -0.3, 1.02)]


def test_archives(spark, tmp_path):
    for name, text in (("p1.streets.json", "a"), ("p2.streets.json", "b"), ("p2__1.streets.json", "c")):
        (tmp_path / name).write_text(text)
    digests = volumes.file_digests(spark, f"{tmp_path}/*.json")
    got = volumes.gathered_inputs(digests, rows(spark, "page string", ("p1",), ("p2",), ("p2__1",))).first()
    parts = sorted(f"{n}\0{hashlib.sha256(t.encode()).hexdigest()}" for n, t in (("p1.streets.json", "a"), ("p2__1.streets.json", "c")))
    assert (got["n"], got["digest"]) == (2, "sha256:" + hashlib.sha256("\n".join(parts).encode()).hexdigest())
    assert volumes.gathered_inputs(digests, rows(spark, "page string")).first()["n"] == 3
    run = f"{tmp_path}/run"
    assert not volumes.is_complete(spark, run)
    volumes.archive_run({"poses": rows(spark, "page string", ("p1",))}, rows(spark, "run string", ("r1",)), run)
    assert volumes.is_complete(spark, run) and spark.read.parquet(f"{run}/poses").count() == 1
    contents = rows(spark, "name string, digest string, content binary", ("a", "1", b"x"), ("b", "1", b"x"), ("c", "2", b"y"))
    for _ in range(2):
        assert volumes.archive_streets(contents, f"{tmp_path}/store").count() == 3
        assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    manifests = rows(spark, "run string, inputs string, commit string, flags array<string>", ("a", "i", "c1", ["--x", "--num-workers", "3"]), ("b", "j", "c1", ["--x"]), ("c", "i", "c2xxxxxxxxx", ["--x"]), ("d", "i", "c1", []), (None, None, None, None))
    why = {r["run"]: r["differs"] for r in volumes.archive_differs(manifests, F.lit("i"), F.lit("c1"), F.array(F.lit("--x"))).collect()}
    assert why == {"a": None, "b": "inputs (reads, centerlines or truth)", "c": "a different commit (c2xxxxxx)", "d": "different flags", None: "an unreadable manifest"}
    old = rows(spark, "page string, modified long", ("p1", 5), ("p2", 5), ("p3", 5))
    assert {r["page"] for r in volumes.pending(old, rows(spark, "page string, modified long", ("p1", 9), ("p2", 3))).collect()} == {"p2", "p3"}


def test_sinks(spark, tmp_path):
    panels = rows(spark, "volume string, page string, panel int, ring array<array<double>>, width double, height double", ("v", "p1", 1, [[60.0, 3.0], [70.0, 9.0]], 9.0, 9.0), ("v", "p1", 2, [[0.0, 9.0], [5.0, 20.0]], 9.0, 9.0), ("v", "p1", 3, [[0.0, 200.0]], 9.0, 9.0))
    volumes.write_panels(panels, f"{tmp_path}/panels")
    doc = spark.read.json(f"{tmp_path}/panels").first()
    assert (doc["volume"], doc["page"]) == ("v", "p1") and [p[0][0] for p in doc["panels"]] == [0.0, 60.0, 0.0]
    volumes.write_report(rows(spark, "page string, rmse double", ("p2", 3.0), ("p1", 2.0)), rows(spark, "page string", ("p0",)), f"{tmp_path}/report")
    text = "".join(sorted(p.read_text() for p in (tmp_path / "report").glob("*.csv")))
    assert text.count("page\trmse\tmissing") >= 1 and "p1\t2.0\tfalse" in text and "p0\t\"\"\ttrue" in text.replace("\t\t", "\t\"\"\t")
    volumes.write_key_maps(rows(spark, "volume string, key string", ("v", "10"), ("v", "2"), ("v", "A")), f"{tmp_path}/maps")
    assert spark.read.json(f"{tmp_path}/maps").first()["keys"] == ["2", "10", "A"]


def test_labels(spark):
    schema = "sheet long, key long, text string, confidence double, x double, y double, dir double, angle int, long_side double, short_side double"
    words = rows(spark, schema, (1, 1, "VAN", 0.9, 100.0, 50.0, 0.0, 0, 60.0, 20.0), (1, 2, "BRUNT", 0.4, 180.0, 55.0, 0.0, 0, 90.0, 20.0), (1, 3, "DYKE", 0.8, 180.0, 300.0, 0.0, 0, 90.0, 20.0), (1, 4, "MAIN", 0.95, 20.0, 50.0, 0.0, 0, 60.0, 20.0))
    names = rows(spark, "name string", ("VAN BRUNT STREET",), ("VAN DYKE STREET",), ("M STREET",), ("AVENUE W",))
    assert [tuple(r) for r in labels.multiword(words, names).collect()] == [(1, 1, 2, "VAN BRUNT")]
    letters = rows(spark, schema, (1, 1, "ST", 0.9, 100.0, 50.0, 0.0, 0, 30.0, 20.0), (1, 2, "M", 0.6, 60.0, 52.0, 0.0, 0, 20.0, 20.0), (1, 3, "W", 0.5, 62.0, 52.0, 0.0, 0, 20.0, 20.0), (1, 4, "M", 0.9, 60.0, 52.0, 0.0, 180, 20.0, 20.0), (2, 5, "AVE.", 0.9, 10.0, 50.0, math.pi / 2, None, 30.0, 20.0), (2, 6, "W", 0.5, 12.0, 90.0, math.pi / 2, None, 30.0, 20.0))
    assert {(r["sheet"], r["key"], r["name"]) for r in labels.promoted_letters(letters, names).collect()} == {(1, 2, "M STREET"), (2, 6, "AVENUE W")}
    turned = {(r["sheet"], r["key"]): r["dir"] for r in labels.turned_squares(letters.union(rows(spark, schema, (2, 7, "K", 0.5, 30.0, 60.0, 0.0, 0, 21.0, 20.0), (2, 8, "K", 0.5, 900.0, 60.0, 0.0, 0, 21.0, 20.0)))).collect()}
    assert turned[2, 7] == round(math.pi / 2, 4) and turned[2, 8] == 0.0 and turned[1, 1] == 0.0
    sides = rows(spark, "volume long, text string, confidence double, short_side double, hint boolean, ignore boolean", *[(1, "AB", 0.9, float(s), None, False) for s in range(1, 102)], (1, "A", 0.9, 999.0, None, None), (1, "AB", 0.9, 999.0, True, None), (1, "AB", 0.1, 999.0, None, None))
    assert labels.auto_side(sides, 0.5, 5).first()["side"] == pytest.approx(6.0)


def test_sessions_over_batches(spark, tmp_path):
    """State lasts from batch to batch."""
    schema = "user_id long, ts timestamp"
    for i, times in enumerate((["2024-01-01 00:00:00", "2024-01-01 00:10:00"], ["2024-01-01 00:30:00", "2024-01-01 02:00:00"])):
        spark.createDataFrame([(1, t) for t in times], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    from plumbline.streaming.upsert import upserted

    assert [tuple(r) for r in upserted(stateful.sessions(stream), ["user_id"]).collect()] == [(1, 2, 4)]


def test_late_rows_are_left_out(spark, tmp_path):
    """A window that the watermark has passed takes no more rows."""
    for i, times in enumerate((["2024-01-01 10:00:00"], ["2024-01-01 20:00:00"], ["2024-01-01 10:05:00", "2024-01-01 20:05:00"])):
        spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("ts timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
        counts = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.hour("w.start").alias("h"), "n")
        query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, e, i=i: b.write.mode("append").parquet(f"{tmp_path}/out")).start()
        query.awaitTermination()
    got = {r["h"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("h").agg(F.max("n").alias("n")).collect()}
    assert got == {10: 1, 20: 2}
