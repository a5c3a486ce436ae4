"""Spatial and adjacency operators against plain loops and stated cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import documents, geo, keys, streets
from plumbline.operators import adjacency, greedy, spatial
from plumbline.plans import decisions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(x)


def test_street_names(spark):
    cases = {
        "S. 4TH ST": "SOUTH FOURTH STREET", "21 ST Ave": "TWENTY FIRST AVENUE", "St. Charles Av.": "SAINT CHARLES AVENUE", "E": "EAST", "103rd st": "103RD STREET", "": "", "ne 30th pl": "NORTHEAST THIRTIETH PLACE", "N ST": "NORTH STREET",
        "1 st st": "FIRST STREET", "10th": "TENTH", "K-Street": "K STREET",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", streets.normalize_street(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases
    got = one(spark, base=streets.base_name(lit("K STREET SOUTHEAST")), fam=streets.name_family(lit("NORTH BONNIE BEACH PLACE")), lone=streets.name_family(lit("NORTH")), hint=streets.hint_type(lit("A V.")), none=streets.hint_type(lit("N.W.")),
              bare=streets.is_bare_letter(lit(" M ")), number=streets.is_number_only(lit("12-3")), letters=streets.printed_letters(lit("ST. 9")))
    assert tuple(got) == ("K STREET", "BONNIE BEACH", "NORTH", "AVENUE", None, True, True, 3)


def test_street_matches(spark):
    names = ["SAINT CHARLES AVENUE", "VAN BRUNT STREET", "VAN DYKE STREET", "AVENUE W", "W", "WEST 9TH STREET", "WEST STREET", "MAGAZINE STREET", "HARBOR ISLAND STREET", "CLINTON AVENUE", "CLINTON STREET", "SOUTH LIBERTY STREET"]
    cases = {
        "CHARLES": ["SAINT CHARLES AVENUE"], "VAN": [], "W": ["W"], "West": ["WEST STREET"], "Magazine": ["MAGAZINE STREET"], "Harbor": ["HARBOR ISLAND STREET"], "CLINTON": ["CLINTON AVENUE", "CLINTON STREET"],
        "Liberty": ["SOUTH LIBERTY STREET"], "Van Brunt St Extension": ["VAN BRUNT STREET"], "NOWHERE": [],
    }
    labels, known = spark.createDataFrame([(k,) for k in cases], "label string"), spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["label"]: r["names"] for r in streets.matches(labels, known).collect()} == cases
    assert {r["label"] for r in streets.matches_any(labels, known).collect()} >= {k for k, v in cases.items() if v and k not in ("W", "West")}
    index = {r["alias"]: r["name"] for r in spatial.street_index(known).collect()}
    assert index["MAGAZINE"] == "MAGAZINE STREET" and index["LIBERTY STREET"] == index["LIBERTY"] == "SOUTH LIBERTY STREET" and "CLINTON" not in index and index["W"] == "W"
    ways = {r["text"] for r in streets.vocabulary(spark.createDataFrame([("WEST MAIN STREET",)], "name string")).collect()}
    assert {"WEST MAIN STREET", "W MAIN ST.", "MAIN", "W. MAIN", "MAIN ST"} <= ways


def test_page_keys(spark):
    cases = [
        ("https://x/a:1950-0006N/info.json", "", "p6N"), ("https://x/1951-0425/info.json", "", "p425"), ("service:x:sb001250", "", "p125"), ("service:x:sb00154s", "", "p154s"), ("x/1950-0156/info.json", "t [2]", "p156__2"),
        (None, "New Orleans, La. | 1951 | Vol. 5 p428 [2]", "p428__2"), ("", "Los Angeles | Vol. 14 pa [2]", "pa__2"), (None, "no page", ""), ("a:01790_01N_1950-covr", "", "covr"),
    ]
    rows = spark.createDataFrame(cases, "s string, l string, want string").select("want", keys.source_page_key(F.col("s"), F.col("l")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    got = one(spark, a=keys.georef_page_key(lit("x/v_p16s.gcps.georef-final.json")), b=keys.georef_page_key(lit("p16.json")), c=keys.sheet_label(lit("p35b__2"))["label"], d=keys.page_key(lit("p1499ab")), e=keys.two_page_number(lit("sb000570.raw.jpg")),
              f=keys.two_page_number(lit("sb00001d.jpg")), g=keys.two_page_number(lit("sb00001a.jpg")), h=keys.georef_variant(lit("p239__2.georef-1gcp.json"))["variant"], i=keys.canvas_page_key(lit("a:b:covr"), lit("")), j=keys.key_stem(lit("35F")))
    assert tuple(got) == ("p16s", None, "35B", "1499AB", 57, 1, None, "1gcp", "covr", "35")
    array = lambda *xs: F.array(*map(F.lit, xs))
    got = one(spark, spec=keys.page_spec_text(array("3", "1", "2", "7", "33a", "2")), none=keys.page_spec_text(F.array().cast("array<string>")), skeletons=keys.without_skeletons(array("201", "201S", "5S")),
              flags=keys.flags_for_hash(array("--a", "--num-workers", "4", "--b")), veto=keys.is_text_veto(lit("SM ITH"), lit(0.9), lit(0.5)), weak=keys.is_text_veto(lit("AL"), lit(0.4), lit(0.5)), lost=keys.is_lost_digits(lit("6"), lit("65")), same=keys.is_lost_digits(lit("65"), lit("65")))
    assert tuple(got) == ("1-3,7,33A", "", ["201", "5S"], ["--a", "--b"], True, False, True, False)
    import hashlib
    import json

    inputs = {"b": "2", "a": "1"}
    want = hashlib.sha256(json.dumps({"flags": ["--x"], "inputs": inputs}, sort_keys=True).encode()).hexdigest()[:8]
    assert one(spark, h=keys.config_hash(array("--x"), F.create_map(*[F.lit(x) for p in inputs.items() for x in p])))[0] == want


def test_documents(spark):
    got = one(spark, page=documents.embedded_json(lit('<script>{"map": {"a": [1, "}\\"]"], "b": {}}, "x": 1}'), "map"), none=documents.embedded_json(lit("no"), "map"), bbox=documents.bbox(documents.geometry_lines(lit("Polygon"), lit("[[[1,2],[3,4],[1,9]]]"))),
              n=F.size(documents.segments(documents.geometry_lines(lit("MultiLineString"), lit("[[[0,0],[1,1],[2,2]],[[5,5]]]")))), kind=documents.dropped_kind(lit('{"panels": []}')), drop=documents.should_drop(lit("service"), lit("driveway")),
              keep=documents.should_drop(lit("service"), lit(None).cast("string")), svg=documents.svg_polygon(F.array(*[F.array(lit(float(a)), lit(float(b))) for a, b in ((0, 0), (2, 0), (2, 1.25))])))
    assert got["page"] == '{"a": [1, "}\\"]"], "b": {}}' and got["none"] is None and tuple(got["bbox"]) == (1.0, 3.0, 2.0, 9.0) and got["n"] == 2
    assert (got["kind"], got["drop"], got["keep"]) == ("panels", True, False) and got["svg"] == '<svg><polygon points="0.0,0.0 2.0,0.0 2.0,1.3" /></svg>'
    jpeg = bytes.fromhex("ffd8ffe000040000ffc0001108") + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" + bytes(9)
    rows = spark.createDataFrame([(1, jpeg), (2, b"GIF"), (3, None)], "i int, c binary").select("i", documents.jpeg_size(F.col("c")).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"]) for r in rows] == [(640, 480), (None, None), (None, None)]
    lines = spark.createDataFrame([("f", 1, '{"target": "a", "n": 1}'), ("f", 2, '{"target": "b", "n": 2}'), ("f", 3, '{"target": "a", "n": 3}'), ("f", 4, '{"tar')], "file string, position int, line string")
    assert sorted((r["target"], r["n"]) for r in documents.latest_records(lines, "target string, n int").collect()) == [("a", 3), ("b", 2)]
    crossings = "array<struct<x:double,y:double,inlier:boolean>>"
    rows = spark.createDataFrame([([(0.0, 0.0, True), (50.0, 0.0, True), (100.0, 0.0, True), (0.0, 300.0, False)],), ([],), (None,)], f"c {crossings}")
    assert [r[0] for r in rows.select(documents.effective_crossings(F.col("c"))).collect()] == [2, 0, 0]


def test_overlapping_boxes(spark):
    rng = random.Random(2)
    make = lambda n, sides: [(i, *(p := (rng.uniform(-500, 500), rng.uniform(-500, 500))), p[0] + rng.choice(sides), p[1] + rng.choice(sides)) for i in range(n)]
    left, right = make(80, [0, 1, 300]), make(60, [0, 3, 700])
    schema = "id long, x0 double, y0 double, x1 double, y1 double"
    got = {tuple(r) for r in spatial.overlapping_boxes(spark.createDataFrame(left, schema), spark.createDataFrame([*right, (99, None, 0.0, 1.0, 1.0)], schema)).collect()}
    assert got == {(a[0], b[0]) for a in left for b in right if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert spatial.overlapping_boxes(spark.createDataFrame(left, schema), spark.createDataFrame([], schema)).count() == 0


def test_panels_and_matches(spark):
    square = lambda x: [[x, 0.0], [x + 10, 0.0], [x + 10, 10.0], [x, 10.0]]
    panels = spark.createDataFrame([(1, 1, square(0.0)), (1, 2, square(20.0))], "sheet long, panel long, ring array<array<double>>")
    points = spark.createDataFrame([(1, 7, 5.0, 5.0), (1, 8, 13.0, 5.0), (1, 9, 18.0, 30.0)], "sheet long, id long, x double, y double")
    assert {(r["id"], r["panel"]) for r in spatial.panel_of(points, panels).collect()} == {(7, 1), (8, 1), (9, 2)}
    pairs = spark.createDataFrame([(1, 1, 1, 9.0), (1, 1, 2, 8.0), (1, 2, 1, 7.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0)], "g long, a long, b long, s double")
    assert {tuple(r)[1:3] for r in spatial.matched(pairs, "g", "a", "b", "s").collect()} == {(1, 1), (2, 2)}
    held = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.9, 1), (1, 1, 0.5, 2), (1, 3, 0.1, 1)], "g long, d long, c double, l long")
    found = spatial.first_holding(held, "g", "d", "c", "l")
    assert {tuple(r) for r in found.collect()} == {(1, 2, 1), (1, 1, 2)}
    detections = spark.createDataFrame([(1, d, str(d)) for d in (1, 2, 3)], "sheet long, detection long, text string")
    labels = spark.createDataFrame([(1, 1, "2"), (1, 2, "x")], "sheet long, label long, text string")
    got = spatial.detection_score(detections, labels, found.toDF("sheet", "detection", "label")).first()
    assert (got["hits"], got["misses"], got["false_alarms"], got["recall"], got["disagreements"]) == (2, 0, 1, 1.0, 1)


def test_compared_pages(spark):
    truth = spark.createDataFrame([("p1", None, None), ("p2", 1, 100.0), ("p2", 2, 100.0), ("p3", None, None)], "page string, panel int, area double")
    placed = spark.createDataFrame([("p1", 5, None, None), ("p1", 6, None, None), ("p2", 7, 1, 90.0), ("p2", 7, 2, 40.0), ("p2", 8, 1, 20.0)], "page string, key int, panel int, common double")
    got = {(r["page"], r["panel"]): r["found"] for r in spatial.compared_pages(truth, placed).collect()}
    assert got == {("p1", None): 5, ("p2", 1): 7, ("p2", 2): None, ("p3", None): None}
    pages = lambda *names: spark.createDataFrame([(n,) for n in names], "page string")
    assert {r[0] for r in spatial.without_skeleton_twins(pages("p1", "p1s", "p2", "p2s", "p3s"), pages("p2s")).collect()} == {"p1", "p2s", "p3s"}
    with pytest.raises(Exception, match="compound suffix"):
        spatial.without_skeleton_twins(pages("p6ns"), pages("p1")).collect()


def test_sheet_repairs(spark):
    labels = spark.createDataFrame([(1, 0, "2"), (1, 1, "2"), (1, 2, "21"), (1, 3, "28"), (1, 4, "3")], "sheet long, index long, label string")
    touching = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 0, 4)], "sheet long, i long, j long")
    graph = lambda *pairs: spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "key string, other string")
    mutual, one_sided = graph(("22", "21"), ("22", "28"), ("7", "21")), graph(("7", "28"), ("7", "3"), ("9", "3"))
    wanted = spark.createDataFrame([(1, k) for k in ("2", "21", "22", "28", "3", "7", "9")], "sheet long, key string")
    got = adjacency.sheet_repairs(labels, touching, mutual, one_sided, wanted).collect()
    assert [(r["index"], r["old"], r["new"], r["support"], r["evidence"]) for r in got] == [(1, "2", "22", 2.0, ["21", "28"])]
    gaps = adjacency.gap_repairs(labels, mutual, one_sided, wanted)
    assert {(r["key"], r["support"]) for r in gaps.collect()} == {("22", 2.0), ("7", 1.5)}
    at = spark.createDataFrame([(1, "21", 0.0, 0.0), (1, "28", 4.0, 0.0), (1, "3", 900.0, 0.0)], "sheet long, label string, x double, y double")
    places = {r["key"]: (r["x"], r["y"]) for r in adjacency.gap_places(gaps, at, spark.createDataFrame([(1, 10.0)], "sheet long, pitch double")).collect()}
    assert places == {"22": (2.0, 0.0), "7": (2.0, 0.0)}
    ask = spark.createDataFrame([(1, 1, "22"), (1, 0, "22")], "sheet long, index long, key string")
    assert [r["index"] for r in adjacency.displaceable(ask, labels, touching, mutual, one_sided).collect()] == [1]
    two = labels.union(spark.createDataFrame([(2, 0, "21"), (2, 1, "5")], labels.schema))
    cross = adjacency.cross_sheet_repairs(two, touching, graph(("21", "2")), one_sided, spark.createDataFrame([], "key string, n int")).collect()
    assert {(r["sheet"], r["index"], r["old"]) for r in cross} == {(2, 0, "21")}


def test_reads_and_labels(spark):
    known = spark.createDataFrame([(1, k) for k in ("1409", "1402", "1499G", "60W", "8S", "9S", "9N")], "volume long, key string")
    reads = [(1, 1, "409", ""), (1, 2, "14027", None), (1, 3, "1499", "I499 g"), (1, 4, "60", ""), (1, 5, "8", ""), (1, 6, "9", ""), (1, 7, "1409", "x"), (1, 8, "", "abc"), (1, 9, "02", "")]
    got = {r["id"]: (r["key"], r["method"]) for r in adjacency.resolve_page_keys(spark.createDataFrame(reads, "volume long, id long, digit_text string, letter_text string"), known).collect()}
    assert got == {1: ("1409", "suffix"), 2: ("1402", "embedded"), 3: ("1499G", "lettered"), 4: ("60W", "number"), 5: ("8S", "number"), 7: ("1409", "exact")}
    labels = spark.createDataFrame([(1, "f", " 35a? "), (1, "f", "12"), (1, "f", "12"), (1, "g", "7"), (1, "g", "7"), (1, "g", "")], "volume long, file string, text string")
    pages = spark.createDataFrame([(1, "35A", 0, False), (1, "12", 0, False), (1, "7", 2, False), (1, "0", 0, True)], "volume long, label string, panels long, keymap boolean")
    got = {(r["kind"], r["label"], r["suggestion"]) for r in adjacency.label_report(labels, pages).collect()}
    assert got == {("unknown", "35A?", "35A"), ("missing", "35A", None), ("duplicated", "12", None)}
    sheets = spark.createDataFrame([(1, s, k) for s, ks in ((1, "abcd"), (2, "abcx"), (3, "mn")) for k in ks], "volume long, sheet long, key string")
    wanted = spark.createDataFrame([(1, k) for k in "ABCDMN"], "volume long, key string")
    assert [r["sheet"] for r in adjacency.redundant_sheets(sheets, wanted).collect()] == [2]


def test_decisions(spark):
    got = one(spark, a=decisions.hard_signal(lit(2), lit(0.0), lit(0.0), lit(0.0), lit(0.0)), b=decisions.hard_signal(lit(5), lit(110.0), lit(0.0), lit(0.0), lit(0.0)), c=decisions.hard_signal(lit(5), lit(91.0), lit(math.log(2)), lit(0.0), lit(0.0)),
              d=decisions.hard_signal(lit(5), lit(0.0), lit(0.35), lit(0.0), lit(0.0)), e=decisions.rmse_ft(geo.affine(1e-6, 0, -90, 0, -1e-6, 40), geo.affine(1e-6, 0, -90, 0, -1e-6, 40.001), lit(1000.0), lit(500.0)), w=geo.wrap_degrees(lit(180.0)), f=geo.angle_difference(lit(180.0), lit(0.0)))
    assert tuple(got)[:4] == ("gcps=2", "rot_dev=20deg", None, "scale_dev=0.34") or tuple(got)[:4] == ("gcps=2", "rot_dev=20deg", None, "scale_dev=0.35")
    assert got["e"] == pytest.approx(365.2, abs=0.3) and (got["w"], got["f"]) == (-180.0, 180.0)
    options = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, True), (1, 1, 0.1, 0.0, 0.9, False), (1, 2, 0.1, 0.0, 0.2, False), (1, 3, 0.0, 0.0, None, False)], "page long, option long, lon double, lat double, evidence double, published boolean")
    assert {r["option"]: r["ambiguous"] for r in decisions.ambiguous(options).collect()} == {0: False, 1: True, 2: True, 3: False}
    stamps = spark.createDataFrame([(1, "a", "b", 0.0, 0.0), (1, "a", "b", 1.0, 0.0), (1, "b", "a", 0.0, 0.0005), (1, "c", "a", 0.0, 0.0)], "volume long, page string, other string, lon double, lat double")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "c")], "volume long, a string, b string")
    pages = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (1, "c", 0.0)], "volume long, page string, log_scale double")
    assert [(r["a"], r["b"], round(r["distance"]), r["bad"]) for r in decisions.contradictions(stamps, edges, pages).collect()] == [("a", "b", 56, False)]
    points = spark.createDataFrame([(1, float(m)) for m in (10, 20, 30, 40, 400)] + [(2, 5.0)], "volume long, metres double")
    assert {r["volume"]: (r["radius"], r["source"]) for r in decisions.search_radius(points, 1000.0).collect()} == {1: (pytest.approx(356.0), "calibrated"), 2: (1000.0, "locator")}


def test_pitch_and_neighbours(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.uniform(0, 100), rng.uniform(0, 100)) for s in range(3) for i in range((2, 9, 14)[s])]
    points = spark.createDataFrame(rows, "sheet long, index long, x double, y double")
    pitch = {r["sheet"]: r["pitch"] for r in adjacency.page_pitch(points).collect()}
    by, want = defaultdict(list), set()
    for s, i, x, y in rows:
        by[s].append((i, x, y))
    for s, ps in by.items():
        d = sorted(min(math.dist(a[1:], b[1:]) for b in ps if b != a) for a in ps)
        assert pitch[s] == (pytest.approx(d[len(d) // 2]) if len(ps) >= 3 else 0.0)
        want |= {(s, a[0], b[0]) for a in ps for b in ps if a[0] < b[0] and pitch[s] > 0 and math.dist(a[1:], b[1:]) <= 1.5 * pitch[s]}
    assert {tuple(r) for r in adjacency.proximity(points).collect()} == want


def test_crossings_near_a_pole_stay_apart(spark, tmp_path):
    from plumbline.plans import registry

    rows = spark.range(40).select((F.col("id") % 2).alias("l_suppkey"), (500_000 + F.floor(F.col("id") / 2)).alias("l_partkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in registry.QUERIES["shared_crossings"](spark, str(tmp_path)).collect()] == [("0000000", "0000001", 20, 20)]


def test_street_crossings_against_loops(spark):
    rng = random.Random(6)
    at = [(round(-100 + rng.randrange(9) * 1e-4, 7), round(40 + rng.randrange(9) * 1e-4, 7)) for _ in range(40)] + [(-90 + i / 100, 41.0) for i in range(20)]
    nodes = sorted({(f"s{rng.randrange(8)}", *rng.choice(at)) for _ in range(160)})
    df = spark.createDataFrame([*nodes, *nodes[:9], ("s1", None, 1.0), (None, *at[0])], "street string, lon double, lat double")
    streets_of = defaultdict(set)
    for s, x, y in nodes:
        streets_of[s].add((x, y))
    want = []
    for a in streets_of:
        for b in streets_of:
            p = np.array(sorted(streets_of[a] & streets_of[b])).reshape(-1, 2)
            if a < b and len(p):
                cluster = greedy.first_match(p * [geo.DEGREE_FT * math.cos(math.radians(p[:, 1].mean())), geo.DEGREE_FT], spatial.SAME_CROSSING_FT)
                want += [(a, b, *(float(v) for v in np.round(p[cluster == c].mean(axis=0), 7)), int((cluster == c).sum())) for c in set(cluster.tolist())]
    assert sorted(map(tuple, spatial.street_crossings(df).collect())) == sorted(want) and any(w[4] > 1 for w in want)
    counts = {(a, b): (sum(w[:2] == (a, b) for w in want), sum(w[4] for w in want if w[:2] == (a, b))) for a, b, *_ in want}
    assert {tuple(r)[:2]: tuple(r)[2:] for r in spatial.counted_crossings(df).collect()} == counts
