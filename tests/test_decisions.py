"""Decision rules on records made by hand."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import spatial
from plumbline.plans import decisions

CANDIDATE = "struct<select_score:double,verification:double,name:double,scale:double,lon:double,lat:double,theta_deg:double,effective_gcps:int>"


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def cand(score, ver, name=0.0, scale=1.0, lon=0.0, theta=0.0, gcps=None):
    return (score, ver, name, scale, lon, 0.0, theta, gcps)


def test_margins(spark):
    cases = [
        [cand(2.0, 1.0), cand(1.9, 1.0, lon=0.0005), cand(1.5, 1.0, lon=0.01), cand(1.8, 1.0, lon=0.0, theta=355.0)], [cand(2.0, 1.0), cand(1.9, 1.0, theta=11.0)], [cand(2.0, 1.0)], [cand(None, 1.0), cand(1.0, 1.0)], [], [cand(2.0, 1.0), cand(None, 1.0, lon=1.0), cand(0.5, 1.0, lon=1.0)],
    ]
    df = rows(spark, f"i int, cs array<{CANDIDATE}>", *enumerate(cases))
    got = {r["i"]: r["m"] for r in df.select("i", decisions.distinct_margin(F.col("cs")).alias("m")).collect()}
    assert got == {0: pytest.approx(0.5), 1: pytest.approx(0.1), 2: math.inf, 3: None, 4: None, 5: pytest.approx(1.5)}
    alone = {r["i"]: r["m"] for r in df.where("i IN (0, 2)").select("i", decisions.uncorroborated_margin(F.col("cs"), lambda c: c["lon"] > 0).alias("m")).collect()}
    assert alone == {0: pytest.approx(0.2), 2: math.inf}
    mixed = rows(spark, f"cs array<{CANDIDATE}>", ([cand(1.0, 0.0, lon=1.0), cand(None, 0.0, lon=2.0), cand(3.0, 0.0, lon=3.0), cand(1.0, 0.0, lon=4.0)],))
    assert [c["lon"] for c in mixed.select(decisions.ranked(F.col("cs")).alias("r")).first()["r"]] == [3.0, 1.0, 4.0, 2.0]


def test_choices(spark):
    schema = f"i int, inc {CANDIDATE}, top {CANDIDATE}, margin double, away double"
    df = rows(
        spark, schema, (0, cand(1.0, 0.3, gcps=4), cand(1.0, 0.4), 9.0, 20.0), (1, cand(1.0, 0.3, gcps=1), cand(1.0, 0.4), 9.0, 20.0), (2, cand(1.0, 0.3), cand(1.0, 0.34), 9.0, 20.0), (3, cand(1.0, 0.3), cand(1.0, 0.9), 9.0, 200.0),
        (4, cand(1.0, 0.05), cand(1.0, 0.9), 0.3, 200.0), (5, cand(1.0, 0.05), cand(1.0, 0.9), 0.2, 200.0), (6, cand(1.0, 0.05, name=0.5), cand(1.0, 0.9, name=0.4), 0.3, 200.0), (7, cand(1.0, 0.05), cand(0.5, 0.9), 0.3, 200.0), (8, None, cand(1.0, 0.9), 0.3, 20.0),
    )
    got = df.select("i", decisions.refines(F.col("inc"), F.col("top"), F.col("away")).alias("r"), decisions.challenges(F.col("inc"), F.col("top"), F.col("margin"), F.col("away"), 0.8).alias("c")).collect()
    assert {r["i"] for r in got if r["r"]} == {0} and {r["i"] for r in got if r["c"]} == {4}


def test_rung_flips(spark):
    schema = f"i int, inc {CANDIDATE}, cs array<{CANDIDATE}>, note double"
    up, better, down, weak = cand(1.0, 0.5, scale=2.0), cand(1.0, 0.6, scale=1.9), cand(1.0, 0.9, scale=0.5), cand(0.5, 0.9, scale=2.0)
    inc = cand(1.0, 0.2)
    df = rows(spark, schema, (0, inc, [weak, up, better, down], None), (1, inc, [down], None), (2, inc, [down], 0.5), (3, inc, [up], 0.5), (4, cand(1.0, 0.45), [up], None), (5, cand(1.0, 0.2, name=0.5), [cand(1.0, 0.5, name=0.3, scale=2.0)], None), (6, cand(1.0, 0.2, scale=0.0), [up], None))
    got = {r["i"]: r["f"] for r in df.select("i", decisions.rung_flip(F.col("inc"), F.col("cs"), F.col("note")).alias("f")).collect()}
    assert got == {0: 2, 1: None, 2: 0, 3: 0, 4: None, 5: None, 6: None}


def test_notes_and_scales(spark):
    pages = rows(spark, "volume long, page string, px_per_ft double, note int", (1, "a", 1.25, 50), (1, "b", 1.2, 50), (1, "c", 0.625, 100), (1, "d", 0.9, 100), (1, "e", 2.5, 50), (2, "x", 1.0, 50), (2, "y", 9.0, None), (3, "z", 1.25, 50))
    got = {r["page"]: r["verdict"] for r in decisions.note_verdicts(pages).collect()}
    assert got == {"a": "keep", "b": "keep", "c": "keep", "d": "drop", "e": "keep", "x": "keep", "z": "keep"}
    ratios = {r["page"]: round(r["ratio"], 6) for r in decisions.note_ratios(rows(spark, "volume long, page string, scale double, note int", (1, "a", 1.0, 50), (1, "b", 1.0, 50), (1, "c", 1.0, 100), (2, "d", 1.0, 50))).collect()}
    assert ratios == {"a": 1.0, "b": 1.0, "c": 2.0}
    near = {r["page"]: (r["n"], r["median"]) for r in decisions.near_scales(rows(spark, "page long, lon double, lat double, scale double", (1, 0.0, 0.0, 1.0), (2, 1.4, 0.0, 2.0), (3, -1.5, 1.5, 4.0), (4, 9.0, 9.0, 8.0)), 1.0, 1.0).collect()}
    assert near == {1: (2, 3.0), 2: (1, 1.0), 3: (1, 1.0)}
    rung = spark.range(1).select(*[decisions.rung_multiplier(F.lit(1.0), F.lit(n), F.lit(m)).alias(f"r{i}") for i, (n, m) in enumerate(((2, 2.1), (1, 2.1), (2, 1.4), (2, 9.0), (2, 0.5)))]).first()
    assert tuple(rung) == (2.0, 1.0, 1.0, 1.0, 0.5)


def test_energies(spark):
    none = F.lit(None).cast("double")
    terms = decisions.unary_terms(F.lit(0.5), F.lit(0.2), none, F.lit(False), F.lit(True), F.lit(3), F.lit(300.0), F.lit(100.0), F.lit(1.4), F.lit(2.0), F.lit(True), F.lit(False))
    got = spark.range(1).select(*[t.alias(k) for k, t in terms.items()], decisions.total(terms.values()).alias("total")).first()
    assert got["evidence"] == pytest.approx(-0.7) and got["entry"] == 1.25 and got["keep_prior"] == -0.68 and got["keymap"] == pytest.approx(0.15) and got["rung"] == 0.3 and got["ambiguity"] == 0.5 and got["contradicted"] is None
    assert got["total"] == pytest.approx(-0.7 + 1.25 - 0.68 + 0.15 + 0.3 + 0.5)
    more = spark.range(1).select(decisions.stamp_energy(F.lit(50.0), F.lit(100.0)).alias("s"), decisions.stamp_energy(F.lit(900.0), F.lit(100.0)).alias("far"), decisions.overlap_energy(F.lit(0.325), F.lit(0.15)).alias("o"), decisions.select_score(F.lit(0.5), F.lit(0.2), none, F.lit(0.0)).alias("score"), decisions.select_score(none, F.lit(0.2), none, none).alias("least")).first()
    assert more["s"] == pytest.approx(0.075) and more["far"] == pytest.approx(0.6) and more["o"] == pytest.approx(1.5) and more["score"] == pytest.approx(0.8) and more["least"] == -math.inf
    shares = decisions.overlap_soft(rows(spark, "volume long, share double", *[(1, s / 10) for s in range(11)], (2, 0.0))).collect()
    assert {r["volume"]: r["soft"] for r in shares} == {1: pytest.approx(0.9), 2: 0.15}


def test_volume_rules(spark):
    options = rows(spark, "page long, option long, points int, carries boolean", (1, 0, 5, True), (1, 1, 0, False), (1, 2, 7, False))
    near = rows(spark, "page long, option long, other long", (1, 1, 0), (1, 0, 2))
    assert {r["option"]: r["points"] for r in decisions.shared_points(options, near).collect()} == {0: 5, 1: 5, 2: 7}
    poses = rows(spark, "volume long, scale double, theta double", (1, 1.0, 350.0), (1, 3.0, 10.0), (1, 2.0, 0.0))
    median = decisions.pose_medians(poses).first()
    assert median["scale"] == 2.0 and median["theta"] == pytest.approx(0.0, abs=1e-9)
    pages = rows(spark, "page string, theta double", ("a", 10.0), ("b", 12.0), ("c", 190.0), ("d", 100.0))
    votes = decisions.turn_votes(pages, rows(spark, "page string, other string", ("a", "b"), ("a", "c"), ("a", "d")), 30.0).first()
    assert (votes["page"], votes["as_is"], votes["turned"]) == ("a", 1, 1)
    hits = decisions.name_alignment(rows(spark, "page string, label string, metres double", ("p", "x", 0.0), ("p", "y", 25.0), ("p", "z", None))).first()
    assert hits["score"] == pytest.approx((1 + math.exp(-1)) / 5) and hits["labels"] == 3
    poses = spatial.hypotheses([("georef", rows(spark, "page string, v double", ("a", 1.0))), ("snap", rows(spark, "page string, v double, rank int", ("a", 2.0, 1), ("a", 3.0, 0), ("b", 4.0, 0)))])
    assert sorted((r["page"], r["option"], r["source"], r["v"]) for r in poses.collect() if r["source"] != "unplaced") == [("a", 0, "georef", 1.0), ("a", 1, "snap", 3.0), ("a", 2, "snap", 2.0), ("b", 0, "snap", 4.0)]
    union = spatial.preferred(rows(spark, "target string, chosen int", ("a", 1), ("b", None)), rows(spark, "target string, chosen int", ("a", 7), ("b", 8), ("c", 9)))
    assert {r["target"]: r["chosen"] for r in union.collect()} == {"a": 1, "b": 8, "c": 9}
    assert spark.range(1).select(geo.is_upside_down(geo.affine(-1e-6, 0, 0, 0, 1e-6, 40)).alias("u")).first()["u"]
