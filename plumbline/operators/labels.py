"""Street labels of a sheet: words that read as one name joined, single letters promoted by a type beside them, square boxes turned.

A label lies in one of twelve buckets of direction; two are in line if they share it, the way they were
read, and their offset across it. Pairs are found by joins within a sheet and bucket; which of them are
taken depends on their order, sheet by sheet.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import streets
from plumbline.session import table

#: Pixels across within which labels are in line, the gap of words by the longer one, least confidences of a word and its partner, pixels within which letters are one, and of a hint.
ACROSS, WORD_GAP, SURE, WEAK, SAME_LETTER, HINT_REACH, SQUARE = 20.0, 0.7, 0.5, 0.05, 10.0, 200.0, 1.5
BUCKETS = 12


def bucket(direction: Column) -> Column:
    """The direction (radians, modulo a half turn) in twelfths."""
    return F.pmod(F.rint(direction / (math.pi / BUCKETS)).cast("int"), F.lit(BUCKETS))


def across(x: Column, y: Column, direction: Column) -> Column:
    return y * F.cos(direction) - x * F.sin(direction)


def in_line(a: str, b: str, tolerance: float) -> Column:
    """Whether label b (columns with that prefix) lies in line with a, measured across a's direction."""
    read = F.col(f"{a}angle").isNull() | F.col(f"{b}angle").isNull() | (F.col(f"{a}angle") == F.col(f"{b}angle"))
    off = across(F.col(f"{b}x"), F.col(f"{b}y"), F.col(f"{a}dir")) - across(F.col(f"{a}x"), F.col(f"{a}y"), F.col(f"{a}dir"))
    return read & (F.abs(off) <= tolerance)


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("sheet", bucket(F.col("dir")).alias("bucket"), *[F.col(c).alias(prefix + c) for c in df.columns if c != "sheet"])


def multiword(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(sheet, first, second, text): words of labels (sheet, key, text, confidence, x, y, dir, angle, long_side) that together name a street of names (name).

    Words of three letters or more in line, close, one of them sure. The surest word takes its surest
    partner; each is used once.
    """
    words = labels.where((F.col("confidence") >= WEAK) & F.trim("text").rlike(r"^\p{L}{3,}$")).select("sheet", "key", F.trim("text").alias("text"), "confidence", "x", "y", "dir", "angle", "long_side")
    met = _side(words, "a_").join(_side(words, "b_"), ["sheet", "bucket"]).where("a_key <> b_key").where(in_line("a_", "b_", ACROSS))
    gap = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) - (F.col("a_long_side") + F.col("b_long_side")) / 2
    met = met.where(gap <= WORD_GAP * F.greatest("a_long_side", "b_long_side")).where(F.greatest("a_confidence", "b_confidence") >= SURE)
    texts = met.select(F.concat_ws(" ", "a_text", "b_text").alias("label")).distinct()
    named = streets.matches(texts, names).where(F.size("names") > 0).select(F.col("label").alias("text"), F.lit(True).alias("named"))
    pairs = met.select("sheet", "a_key", "b_key", "a_confidence", "b_confidence", F.concat_ws(" ", "a_text", "b_text").alias("ab"), F.concat_ws(" ", "b_text", "a_text").alias("ba"))
    pairs = pairs.join(named.toDF("ab", "is_ab"), "ab", "left").join(named.toDF("ba", "is_ba"), "ba", "left").where("is_ab OR is_ba")

    def taken(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a_confidence", "a_key", "b_confidence", "b_key"], ascending=[False, True, False, True])
        used, out = set(), []
        for r in rows.itertuples():
            if r.a_key not in used and r.b_key not in used:
                used |= {r.a_key, r.b_key}
                out.append((r.sheet, r.a_key, r.b_key, r.ab) if r.is_ab is True else (r.sheet, r.b_key, r.a_key, r.ba))
        return pd.DataFrame(out, columns=["sheet", "first", "second", "text"])

    return pairs.groupBy("sheet").applyInPandas(taken, "sheet long, first long, second long, text string")


def promoted_letters(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(sheet, key, text, name): single letters of labels (sheet, key, text, confidence, x, y, dir, angle) in line with a printed type, as the street that the two name.

    Of letters at one place the surest stays.
    """
    typed = labels.withColumn("type", streets.hint_type(F.col("text"))).where("type IS NOT NULL").select("sheet", "type", "x", "y", "dir", "angle")
    letters = labels.where(streets.is_bare_letter(F.col("text"))).select("sheet", "key", F.upper(F.trim("text")).alias("text"), "confidence", "x", "y", "dir", "angle")
    met = _side(typed, "h_").join(_side(letters, ""), ["sheet", "bucket"]).where(in_line("h_", "", ACROSS))
    name = F.when(F.col("h_type") == "AVENUE", F.concat(F.lit("AVENUE "), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit(" STREET")))
    other = F.when(F.col("h_type") == "AVENUE", F.concat(F.col("text"), F.lit(" AVENUE"))).otherwise(F.concat(F.lit("STREET "), F.col("text")))
    each = met.select("sheet", "key", "text", "confidence", "x", "y", F.posexplode(F.array(name, other)).alias("rank", "name")).join(names.select("name").distinct(), "name")
    best = each.groupBy("sheet", "key", "text", "confidence", "x", "y").agg(F.min(F.struct("rank", "name")).alias("n")).select("sheet", "key", "text", "confidence", "x", "y", F.col("n.name").alias("name"))
    rival = best.select("sheet", F.col("key").alias("other"), F.col("confidence").alias("c2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    surer = (F.col("c2") > F.col("confidence")) | ((F.col("c2") == F.col("confidence")) & (F.col("other") < F.col("key")))
    near = (best["sheet"] == rival["sheet"]) & surer & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= SAME_LETTER)
    return best.join(rival, near, "left_anti").select("sheet", "key", "text", "name")


def turned_squares(labels: DataFrame) -> DataFrame:
    """(sheet, key, dir): labels (sheet, key, text, x, y, dir, long_side, short_side); a box about as high as wide takes the direction of the nearest printed type in reach."""
    hints = labels.where(streets.hint_type(F.col("text")).isNotNull()).select("sheet", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("dir").alias("hdir"))
    square = (F.col("short_side") > 0) & (F.col("long_side") < SQUARE * F.col("short_side")) & streets.hint_type(F.col("text")).isNull()
    away = F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy"))
    near = labels.where(square).join(hints, "sheet").where(away <= HINT_REACH).groupBy("sheet", "key").agg(F.min(F.struct(away.alias("away"), "hdir")).alias("h"))
    return labels.join(near, ["sheet", "key"], "left").select("sheet", "key", F.coalesce(F.round(F.pmod(F.col("h.hdir"), F.lit(math.pi)), 4), F.col("dir")).alias("dir"))


def auto_side(labels: DataFrame, least: float, percentile: int) -> DataFrame:
    """(volume, side): the percentile of the short sides of sure labels (volume, text, confidence, short_side, hint, ignore) of two letters or more."""
    letters = F.char_length(F.regexp_replace("text", r"[^\p{L}]", ""))
    used = labels.where((F.col("confidence") >= least) & (letters >= 2) & ~F.coalesce("hint", F.lit(False)) & ~F.coalesce("ignore", F.lit(False)))
    return used.groupBy("volume").agg(F.percentile("short_side", max(1, min(99, percentile)) / 100).alias("side"))


def admitted(text: Column, confidence: Column, short: Column, long: Column, known: Column, *, least: float, min_short: float, min_long: float, aspect: float, share: float) -> Column:
    """Whether a label counts: sure, large enough for how sure it is, long enough for its height, and no number, letter or lone direction that no street is known by."""
    from plumbline.functions import geo

    required = geo.relaxed_threshold(confidence, F.lit(least), F.lit(min_short), F.lit(min_short * share))
    tall, wide = F.coalesce(short, F.lit(float("inf"))), F.coalesce(long, F.lit(float("inf")))
    sized = (wide >= min_long * required / min_short) & (tall >= required) & (wide >= aspect * F.coalesce(short, F.lit(1.0)))
    worded = ~streets.is_number_only(text) & ~streets.is_bare_letter(text) & (~streets.normalize_street(text).isin(*streets.DIRECTIONS) | known)
    return (confidence >= least) & sized & worded


def on_fill(hue: Column, low: float = 40.0, high: float = 110.0) -> Column:
    """Whether a label stands on a building's colour: its background's hue is known and outside the band of paper."""
    return F.coalesce(~hue.between(low, high), F.lit(False))


def dominated(labels: DataFrame, min_short: float, min_long: float) -> DataFrame:
    """(sheet, key) of small labels (sheet, key, street, confidence, x, y, dir, angle, short_side, long_side, promoted) in line with a larger and surer one of another name."""
    small = ~F.coalesce("promoted", F.lit(False)) & ((F.coalesce("short_side", F.lit(float("inf"))) < min_short) | (F.coalesce("long_side", F.lit(float("inf"))) < min_long))
    used = labels.select("sheet", "key", "street", "confidence", "x", "y", "dir", F.lit(None).cast("int").alias("angle"), "short_side")
    own = labels.where(small).select(*used.columns[:7], F.lit(None).cast("int").alias("angle"), "short_side")
    met = _side(own, "").join(_side(used, "b_"), ["sheet", "bucket"]).where("key <> b_key AND street <> b_street AND short_side < b_short_side AND confidence < b_confidence")
    off = across(F.col("b_x"), F.col("b_y"), F.col("b_dir")) - across(F.col("x"), F.col("y"), F.col("dir"))
    return met.where(F.abs(off) <= ACROSS).select("sheet", "key").distinct()


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as labels of their order: placed by quantity, sized by line and discount, in three directions."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").distinct()
    key = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")).cast("long")
    return lines.select(
        c("l_orderkey").alias("sheet"), key.alias("key"), (c("l_partkey") % 7).cast("string").alias("street"), (c("l_discount") * 10).alias("confidence"), (c("l_quantity") * 4.1).alias("x"), (c("l_suppkey") % 30 * 3.0).alias("y"),
        F.when(c("l_partkey") % 3 == 0, 0.0).otherwise(math.pi / 2).alias("dir"), (c("l_linenumber") * 3.0).alias("short_side"), (c("l_tax") * 1000 + 5).alias("long_side"), (c("l_partkey") % 11 == 0).alias("promoted"),
    )


def collinear_dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominated(_labels(spark, sf_dir), 10.0, 40.0)


def label_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted, relaxed and filled labels by supplier."""
    c = F.col
    text = F.concat(F.when(c("l_partkey") % 5 == 0, "").when(c("l_partkey") % 5 == 1, "M").when(c("l_partkey") % 5 == 2, "North").otherwise("Main "), F.when(c("l_partkey") % 5 < 1, "12").when(c("l_partkey") % 5 < 3, "").otherwise("St"))
    ok = admitted(text, c("l_discount") * 10, c("l_linenumber") * 3.0, c("l_quantity") * 2, c("l_suppkey") % 2 == 0, least=0.2, min_short=12.0, min_long=30.0, aspect=1.5, share=0.5)
    hue = F.when(c("l_partkey") % 4 > 0, c("l_quantity") * 4)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(ok).alias("admitted"), F.count_if(on_fill(hue)).alias("filled"), F.count_if(ok & ~on_fill(hue)).alias("kept"))


QUERIES = {"collinear_dominated": collinear_dominated, "label_admission": label_admission}
ORACLES = {
    "collinear_dominated": """WITH l AS (SELECT l_orderkey AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax) AS key, l_partkey % 7 AS street, l_discount * 10 AS confidence, l_quantity * 4.1 AS x,
  l_suppkey % 30 * 3.0 AS y, l_partkey % 3 = 0 AS flat, l_linenumber * 3.0 AS short_side, l_tax * 1000 + 5 AS long_side, l_partkey % 11 = 0 AS promoted FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem))
SELECT DISTINCT a.sheet, a.key FROM l a JOIN l b ON a.sheet = b.sheet AND a.flat = b.flat AND a.street <> b.street AND a.short_side < b.short_side AND a.confidence < b.confidence AND abs(CASE WHEN a.flat THEN b.y - a.y ELSE b.x - a.x END) <= 20
WHERE NOT a.promoted AND (a.short_side < 10 OR a.long_side < 40)""",
    "label_admission": """WITH l AS (SELECT *, l_discount * 10 AS conf, l_linenumber * 3.0 AS s, l_quantity * 2 AS w, l_partkey % 5 AS k, CASE WHEN l_partkey % 4 > 0 THEN l_quantity * 4 END AS hue FROM lineitem),
r AS (SELECT *, CASE WHEN conf <= 0.2 THEN 12.0 ELSE 12.0 * pow(0.2 / least(conf, 1.0), ln(0.5) / ln(0.2)) END AS need FROM l),
a AS (SELECT l_suppkey, conf >= 0.2 AND w >= 30 * need / 12 AND s >= need AND w >= 1.5 * s AND k >= 2 AND (k <> 2 OR l_suppkey % 2 = 0) AS ok, coalesce(hue < 40 OR hue > 110, false) AS filled FROM r)
SELECT l_suppkey, count(*) FILTER (ok) AS admitted, count(*) FILTER (filled) AS filled, count(*) FILTER (ok AND NOT filled) AS kept FROM a GROUP BY l_suppkey""",
}
