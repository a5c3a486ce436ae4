"""Printed references between sheets: reads resolved to page keys, claims to edges, and key-map labels repaired by the edges.

Tables are keyed by volume (and sheet), joins are on keys, and counts of candidates stand beside each
match, so that what isn't unique resolves to nothing. Only the choice of repairs on one sheet depends on
their order; its candidates, found by joins, are few and taken sheet by sheet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import geo, keys
from plumbline.session import table

#: Digits of the shortest key that a cut read may be completed to, and of the shortest such read.
REPAIR_DIGITS, SUFFIX_DIGITS = 3, 3
#: Weight of an unreciprocated claim; mutual neighbours that a new label needs; mutual citations and support that a missing page needs.
ONE_SIDED, RELABEL_MUTUAL, GAP_MUTUAL, GAP_SUPPORT = 0.25, 2, 1, 1.5
#: Page steps that neighbours lie within, that citations of one place lie within, and a number's side in pixels at least.
NEAR_PITCHES, SPREAD_PITCHES, LEAST_SIDE = 1.5, 3.0, 20.0
#: Bands of a claim's height about the confirmed ones' upper median, and degrees off the axes it may have.
SIZE_BAND, HEIGHT_SHARE, TILT = (0.65, 1.4), 0.75, 5.0
#: What an unheard-of number counts, the least margin of a repair and what it may concede, neighbours of a read, and steps of numbers that a repair may be off theirs.
UNSURE, FLOOR, CONCEDE, NEAR_READS, GATE_STEPS = -1e9, -1.5, 1.0, 4, 6.0
#: Shared keys that make two key maps one, and the gap of foreign keys that tells which one goes.
SAME_KEYS, FOREIGN_GAP = 0.5, 0.2


def upper_median(c: Column | str) -> Column:
    """Aggregate: the middle value, the upper one of two."""
    return F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))


def resolve_page_keys(reads: DataFrame, known: DataFrame) -> DataFrame:
    """(id, key, method) of reads (volume, id, digit_text, letter_text) by the keys (volume, key) of their volume.

    In order: the read with letters is a key; the digits are; they are one key's number; they end one
    longer key; one shorter key stands in them. Reads that nothing resolves, or that two keys fit, are left out.
    """
    pattern = "([0-9IO]+)([A-Z]{1,2})$"
    letters = F.upper(F.regexp_replace(F.coalesce("letter_text", F.lit("")), r"\s", ""))
    lettered = F.concat(F.translate(F.regexp_extract(letters, pattern, 1), "IO", "10"), F.regexp_extract(letters, pattern, 2))
    asked = reads.select("volume", "id", F.regexp_replace(F.coalesce("digit_text", F.lit("")), r"\D", "").alias("digits"), F.nullif(lettered, F.lit("")).alias("lettered"))
    known = known.select("volume", "key").dropna().distinct()
    number = known.withColumn("digits", F.regexp_replace("key", r"\D", ""))
    whole = known.where(F.col("key").rlike(r"^\d+$") & (F.length("key") >= REPAIR_DIGITS))
    unique = lambda df, rank, method: df.groupBy("id").agg(F.min("key").alias("key"), F.countDistinct("key").alias("n")).where("n = 1").select("id", "key", F.lit(rank).alias("rank"), F.lit(method).alias("method"))
    n = F.length("digits")
    tails = whole.select("volume", "key", F.explode(F.transform(F.sequence(F.lit(SUFFIX_DIGITS), F.greatest(F.length("key") - 1, F.lit(SUFFIX_DIGITS))), lambda k: F.right("key", k))).alias("digits")).where("length(digits) < length(key)")
    pieces = asked.where(n > REPAIR_DIGITS).select("volume", "id", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(REPAIR_DIGITS), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda a: F.substring("digits", a, k)))))).alias("key"))
    found = unique(asked.join(known.withColumnRenamed("key", "lettered"), ["volume", "lettered"]).withColumn("key", F.col("lettered")), 0, "lettered")
    found = found.union(unique(asked.where("digits <> ''").join(known.withColumn("digits", F.col("key")), ["volume", "digits"]), 1, "exact"))
    found = found.union(unique(asked.where("digits <> ''").join(number, ["volume", "digits"]), 2, "number"))
    found = found.union(unique(asked.where(n >= SUFFIX_DIGITS).join(tails, ["volume", "digits"]), 3, "suffix"))
    found = found.union(unique(pieces.join(whole, ["volume", "key"]), 4, "embedded"))
    return found.groupBy("id").agg(F.min(F.struct("rank", "key", "method")).alias("f")).select("id", "f.key", "f.method")


def is_claim(key: Column, own: Column, edge: Column, height: Column, confidence: Column, polygon: Column, number: Column, band: Column, gap: Column, *, height_floor: Column, least: float, sure: float, least_gap: float) -> Column:
    """Whether a number by a page's edge claims a neighbour; a number of one digit must be surer, of the printed size (band: struct low, high) and alone."""
    plain = key.isNotNull() & ~key.eqNullSafe(own) & (edge != "center") & (height >= height_floor) & (confidence >= least) & (geo.quad_rotation(polygon) <= TILT)
    single = (confidence >= sure) & (band.isNull() | height.between(band["low"], band["high"])) & (gap.isNull() | (gap >= least_gap))
    return F.coalesce(plain & ((number >= 10) | single), F.lit(False))


def height_band(confirmed: DataFrame) -> DataFrame:
    """(volume, low, high, median): the band of heights for numbers of one digit, from confirmed ones (volume, height)."""
    middle = confirmed.where("height IS NOT NULL").groupBy("volume").agg(upper_median("height").alias("median"))
    return middle.select("volume", (F.col("median") * SIZE_BAND[0]).alias("low"), (F.col("median") * SIZE_BAND[1]).alias("high"), "median")


def height_floor(median: Column, least: Column) -> Column:
    """The least height of a volume's claims."""
    return F.greatest(least, F.coalesce(median * HEIGHT_SHARE, least))


def resolved_claims(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """(volume, a, b): claims (volume, stem, claim) as edges to pages (volume, stem); a claim of a bare number falls back to the one page of that number."""
    named = pages.select("volume", F.col("stem").alias("b"), keys.page_key(F.col("stem")).alias("key"), keys.page_number(F.col("stem")).alias("number")).distinct()
    asked = claims.select("volume", F.col("stem").alias("a"), F.upper("claim").alias("key")).dropna().distinct()
    exact = asked.join(named.select("volume", "key", "b"), ["volume", "key"])
    lone = named.where("number IS NOT NULL").groupBy("volume", "number").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("volume", "number", "b")
    other = asked.join(exact.select("volume", "key").distinct(), ["volume", "key"], "left_anti").where(F.col("key").rlike(r"^\d+$"))
    fallen = other.withColumn("number", F.col("key").cast("long")).join(lone, ["volume", "number"])
    return exact.select("volume", "a", "b").union(fallen.select("volume", "a", "b")).where("a <> b").distinct()


def edges_of(directed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mutual (volume, a < b), one-sided (volume, a, b)) of directed edges."""
    back = directed.select("volume", F.col("b").alias("a"), F.col("a").alias("b"))
    mutual = directed.join(back, ["volume", "a", "b"], "left_semi")
    return mutual.where("a < b"), directed.join(mutual, ["volume", "a", "b"], "left_anti")


def key_graph(edges: DataFrame) -> DataFrame:
    """(volume, key, other) both ways, of edges (volume, a, b) between stems; pairs of one key are left out."""
    named = edges.select("volume", keys.page_key(F.col("a")).alias("key"), keys.page_key(F.col("b")).alias("other")).dropna().where("key <> other")
    return named.union(named.select("volume", F.col("other").alias("key"), F.col("key").alias("other"))).distinct()


def neighbours(labels: DataFrame, touching: DataFrame) -> DataFrame:
    """(sheet, index, beside): labels around each label (sheet, index, label), by pairs that touch (sheet, i, j)."""
    both = touching.select("sheet", F.col("i").alias("index"), "j").union(touching.select("sheet", F.col("j").alias("index"), F.col("i").alias("j")))
    beside = labels.select("sheet", F.col("index").alias("j"), F.col("label").alias("beside"))
    return both.join(beside, ["sheet", "j"]).select("sheet", "index", "beside").distinct()


def support(asked: DataFrame, around: DataFrame, mutual: DataFrame, one_sided: DataFrame) -> DataFrame:
    """(sheet, index, key, mutual_n, support, vouchers) of keys at labels (sheet, index, key) by the labels around (sheet, index, beside).

    Mutual neighbours (key, other) count whole, one-sided ones that aren't mutual a part.
    """
    strong = mutual.select("key", F.col("other").alias("beside")).distinct().withColumn("strong", F.lit(1))
    weak = one_sided.select("key", F.col("other").alias("beside")).distinct().withColumn("weak", F.lit(1))
    met = asked.join(around, ["sheet", "index"], "left").join(strong, ["key", "beside"], "left").join(weak, ["key", "beside"], "left")
    strong, weak = F.col("strong").isNotNull(), F.col("strong").isNull() & F.col("weak").isNotNull()
    names = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("beside"))))
    return met.groupBy("sheet", "index", "key").agg(
        F.count_if(strong).alias("mutual_n"), (F.count_if(strong) + F.count_if(weak) * ONE_SIDED).alias("support"), F.concat(names(strong), names(weak)).alias("vouchers")
    )


def sheet_repairs(labels: DataFrame, touching: DataFrame, mutual: DataFrame, one_sided: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sheet, index, old, new, support, evidence): labels of a sheet that stand twice, of which one that no mutual neighbour vouches for is a cut read of a missing key.

    wanted (sheet, key): the keys of the sheet's volume. A key goes to the first label that it alone
    fits, in order of labels and places.
    """
    many = labels.groupBy("sheet", "label").agg(F.count("*").alias("n")).where("n > 1").select("sheet", "label")
    around = neighbours(labels, touching)
    own = support(labels.join(many, ["sheet", "label"]).select("sheet", "index", F.col("label").alias("key")), around, mutual, one_sided)
    open_ = own.where("mutual_n = 0").select("sheet", "index", F.col("key").alias("label"))
    missing = wanted.join(labels.select("sheet", F.col("label").alias("key")).distinct(), ["sheet", "key"], "left_anti")
    family = open_.join(missing, "sheet").where(keys.is_lost_digits(F.col("label"), F.col("key"))).select("sheet", "index", "label", "key")
    found = support(family.select("sheet", "index", "key"), around, mutual, one_sided).where(F.col("mutual_n") >= RELABEL_MUTUAL)
    found = found.join(open_, ["sheet", "index"]).select("sheet", "index", "label", "key", "support", "vouchers")

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (label, index), options in rows.sort_values(["label", "index", "key"]).groupby(["label", "index"]):
            left = options[~options["key"].isin(taken)]
            if len(left) == 1:
                r = left.iloc[0]
                taken.add(r["key"])
                out.append((r["sheet"], index, label, r["key"], r["support"], r["vouchers"]))
        return pd.DataFrame(out, columns=["sheet", "index", "old", "new", "support", "evidence"])

    return found.groupBy("sheet").applyInPandas(chosen, "sheet long, index long, old string, new string, support double, evidence array<string>")


def number_repairs(reads: DataFrame, margins: DataFrame, pages: DataFrame) -> DataFrame:
    """(sheet, index, old, new): reads (sheet, index, text, x, y) that are no page, or repeat one, and the missing pages (sheet, key) that the recogniser thinks best of.

    margins (sheet, index, number, margin): what it thinks of a number at each read. Of reads of one page the
    surest stays. A page must lie near the numbers of its neighbours, and concede little to a read that is a
    page; in order of texts, each takes the best that none took before.
    """
    own = reads.withColumn("stem", keys.key_stem(F.col("text")))
    sure = margins.select("sheet", "index", F.col("number").alias("stem"), "margin")
    own = own.join(sure, ["sheet", "index", "stem"], "left").withColumn("margin", F.coalesce("margin", F.lit(UNSURE)))
    number = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("long"))
    other = own.select("sheet", F.col("index").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"), number("stem").alias("n"))
    rank = F.row_number().over(Window.partitionBy("sheet", "index").orderBy(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")), "j"))
    near = own.join(other, "sheet").where("index <> j").withColumn("rank", rank).where((F.col("rank") <= NEAR_READS) & F.col("n").isNotNull())
    around = near.groupBy("sheet", "index").agg(F.percentile("n", 0.5).alias("middle"))
    steps = near.groupBy("sheet").agg(F.greatest(F.lit(1.0), F.coalesce(F.percentile(F.abs(number("stem") - F.col("n")), 0.5), F.lit(1.0))).alias("step"))
    known = pages.select("sheet", F.col("key").alias("text"), F.lit(True).alias("page")).distinct()
    stems = pages.select("sheet", keys.key_stem(F.col("key")).alias("stem"), F.lit(True).alias("family")).distinct()
    w = Window.partitionBy("sheet", "text")
    judged = own.join(known, ["sheet", "text"], "left").join(stems, ["sheet", "stem"], "left").withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("margin"), "index")))
    suspects = judged.where((F.col("page").isNull() & F.col("family").isNull()) | (F.col("page") & (F.col("n") > 1) & (F.col("place") > 1)))
    missing = pages.select("sheet", "key").distinct().join(reads.select("sheet", F.col("text").alias("key")).distinct(), ["sheet", "key"], "left_anti").withColumn("number", keys.key_stem(F.col("key")))
    options = suspects.select("sheet", "index", "text", "stem", "page", F.col("margin").alias("held")).join(margins, ["sheet", "index"]).join(missing, ["sheet", "number"]).where("number <> stem")
    options = options.where((F.col("margin") > FLOOR) & (F.col("page").isNull() | (F.col("margin") >= F.col("held") - CONCEDE)))
    options = options.join(around, ["sheet", "index"], "left").join(steps, "sheet", "left").where(F.col("middle").isNull() | (F.abs(F.col("number").cast("double") - F.col("middle")) <= GATE_STEPS * F.coalesce("step", F.lit(1.0))))

    def taken(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (text, index), g in rows.sort_values(["text", "index", "margin", "key"], ascending=[True, True, False, False]).groupby(["text", "index"], sort=False):
            best = next((k for k in g["key"] if k not in used), None)
            if best is not None:
                used.add(best)
                out.append((g["sheet"].iloc[0], index, text, best))
        return pd.DataFrame(out, columns=["sheet", "index", "old", "new"])

    return options.select("sheet", "index", "text", "margin", "key").groupBy("sheet").applyInPandas(taken, "sheet long, index long, old string, new string")


def cross_sheet_repairs(labels: DataFrame, touching: DataFrame, mutual: DataFrame, one_sided: DataFrame, panels: DataFrame) -> DataFrame:
    """(sheet, index, old, support, evidence): labels to strip, where a key stands on several sheets and only some of them have it vouched for.

    panels (key, n): panels of split pages, which may stand so often.
    """
    own = support(labels.select("sheet", "index", F.col("label").alias("key")), neighbours(labels, touching), mutual, one_sided)
    sheets = own.groupBy("key", "sheet").agg(F.max("mutual_n").alias("vouched"), F.count("*").alias("copies"))
    split = sheets.groupBy("key").agg(F.count("*").alias("sheets"), F.sum("copies").alias("total"), F.sort_array(F.collect_list(F.when(F.col("vouched") > 0, F.col("sheet")))).alias("evidence"))
    split = split.join(panels, "key", "left").where((F.col("sheets") > 1) & (F.col("total") > F.greatest(F.lit(1), F.coalesce("n", F.lit(1)))) & (F.size("evidence") > 0))
    bad = sheets.where("vouched = 0").select("key", "sheet").join(split.select("key", "evidence"), "key")
    return own.join(bad, ["key", "sheet"]).select("sheet", "index", F.col("key").alias("old"), "support", "evidence")


def gap_repairs(labels: DataFrame, mutual: DataFrame, one_sided: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sheet, key, support, strong, weak): keys that a sheet lacks and enough of its labels cite; strong and weak are the citing labels.

    wanted: (sheet, key), or (key) where all sheets want the same. Labels are dealt by sheet once, and all else stays where they are, in
    more parts than usual, as a sheet's keys are several times its labels.
    """
    n = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = labels.where("sheet IS NOT NULL AND label IS NOT NULL").select("sheet", F.col("label").alias("other")).repartition(8 * n, "sheet").distinct()
    weak = one_sided.select("key", "other").distinct().join(mutual.select("key", "other"), ["key", "other"], "left_anti")
    citing = mutual.select("key", "other").distinct().withColumn("strong", F.lit(True)).union(weak.withColumn("strong", F.lit(False)))
    keys = citing.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("other").agg(F.collect_list(F.struct("key", "strong")).alias("keys"))
    own = F.array(F.struct(F.col("other").alias("key"), F.lit(None).cast("boolean").alias("strong")))  # the label itself: a key that isn't missing
    cited = there.join(keys, "other", "left").select("sheet", "other", F.explode(F.when(F.col("keys").isNull(), own).otherwise(F.concat(own, "keys"))).alias("k")).select("sheet", "other", "k.*")
    names = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("other"))))
    of = {True: F.count_if("strong"), False: F.count_if(~F.col("strong"))}
    each = cited.groupBy("sheet", "key").agg(of[True].alias("n"), (of[True] + of[False] * ONE_SIDED).alias("support"), F.count_if(F.col("strong").isNull()).alias("held"), names(F.col("strong")).alias("strong"), names(~F.col("strong")).alias("weak"))
    found = each.where((F.col("held") == 0) & (F.col("n") >= GAP_MUTUAL) & (F.col("support") >= GAP_SUPPORT)).select("sheet", "key", "support", "strong", "weak")
    return found.join(wanted.select("sheet", "key").distinct(), ["sheet", "key"], "left_semi") if "sheet" in wanted.columns else found


def gap_places(gaps: DataFrame, labels: DataFrame, pitch: DataFrame) -> DataFrame:
    """(sheet, key, x, y): where a missing key belongs: the mean of the labels (sheet, label, x, y) that cite it, one-sided ones only if near.

    Keys without a placed mutual citation, or whose mutual ones lie apart by the sheet's pitch (sheet, pitch), have no place.
    """
    cite = lambda c, strong: gaps.select("sheet", "key", F.explode(c).alias("label"), F.lit(strong).alias("strong"))
    cited = cite("strong", True).union(cite("weak", False)).join(labels.select("sheet", "label", "x", "y").dropna(), ["sheet", "label"])
    w = Window.partitionBy("sheet", "key")
    mean = lambda c: F.avg(F.when(F.col("strong"), F.col(c))).over(w)
    cited = cited.join(pitch, "sheet", "left").withColumn("away", F.hypot(F.col("x") - mean("x"), F.col("y") - mean("y")))
    limit = F.when(F.col("pitch") > 0, F.col("pitch") * SPREAD_PITCHES).otherwise(F.lit(float("inf")))
    cited = cited.withColumn("near", F.col("away") <= limit).withColumn("torn", F.max(F.when(F.col("strong") & ~F.col("near"), True).otherwise(False)).over(w))
    return cited.where("near AND NOT torn").groupBy("sheet", "key").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("strong").alias("anchored")).where("anchored").drop("anchored")


def displaceable(asked: DataFrame, labels: DataFrame, touching: DataFrame, mutual: DataFrame, one_sided: DataFrame) -> DataFrame:
    """(sheet, index, key) of those asked that may take over a label: enough mutual neighbours vouch for the key and nothing does for the label."""
    around = neighbours(labels, touching)
    gain = support(asked.select("sheet", "index", "key"), around, mutual, one_sided).where(F.col("mutual_n") >= RELABEL_MUTUAL)
    held = support(labels.select("sheet", "index", F.col("label").alias("key")), around, mutual, one_sided).where("support = 0")
    return gain.join(held.select("sheet", "index"), ["sheet", "index"], "left_semi").select("sheet", "index", "key")


def shortfall(labels: DataFrame, wanted: DataFrame, panels: DataFrame) -> DataFrame:
    """(volume, key): keys (volume, key) drawn fewer times among labels (volume, label) than the page has panels (volume, key, n)."""
    placed = labels.groupBy("volume", F.col("label").alias("key")).agg(F.count("*").alias("placed"))
    each = wanted.distinct().join(placed, ["volume", "key"], "left").join(panels, ["volume", "key"], "left")
    return each.where(F.coalesce("placed", F.lit(0)) < F.coalesce("n", F.lit(1))).select("volume", "key")


def nearest_distances(points: DataFrame) -> DataFrame:
    """(sheet, index, d): distance of each point (sheet, index, x, y) to the nearest other of its sheet; points of one sheet are few."""
    other = points.select("sheet", F.col("index").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    met = points.join(other, "sheet").where("index <> j")
    return met.groupBy("sheet", "index").agg(F.min(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))).alias("d"))


def page_pitch(points: DataFrame) -> DataFrame:
    """(sheet, pitch): upper median of the nearest distances; 0 for sheets of fewer than three points."""
    placed = points.dropna()
    found = nearest_distances(placed).groupBy("sheet").agg(upper_median("d").alias("pitch"), F.count("*").alias("n"))
    return points.select("sheet").distinct().join(found, "sheet", "left").select("sheet", F.when(F.col("n") >= 3, F.col("pitch")).otherwise(0.0).alias("pitch"))


def proximity(points: DataFrame, factor: float = NEAR_PITCHES) -> DataFrame:
    """(sheet, i, j), i < j: points of a sheet within some pitches of each other. They meet in cells of that size."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    held = points.dropna().join(page_pitch(points).where("pitch > 0"), "sheet").withColumn("r", F.col("pitch") * factor)
    cell = lambda c: F.floor(F.col(c) / F.col("r"))
    left = held.select("sheet", F.col("index").alias("i"), "x", "y", "r", cell("x").alias("cx"), cell("y").alias("cy"))
    right = held.select("sheet", F.col("index").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"), cell("x").alias("rx"), cell("y").alias("ry")).withColumn("dx", near).withColumn("dy", near)
    right = right.select("sheet", "j", "u", "v", (F.col("rx") + F.col("dx")).alias("cx"), (F.col("ry") + F.col("dy")).alias("cy"))
    return left.join(right, ["sheet", "cx", "cy"]).where("i < j").where(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")) <= F.col("r")).select("sheet", "i", "j")


def number_box(boxes: DataFrame) -> DataFrame:
    """(sheet, width, height): medians of a sheet's number boxes (sheet, via, x0, y0, x1, y1), synthetic ones (via) left out, at least a side each."""
    real = F.when(~F.col("via").eqNullSafe("adjacency-gap"), F.lit(1.0))
    side = lambda a, b: F.greatest(F.lit(LEAST_SIDE), F.coalesce(F.percentile((F.col(b) - F.col(a)) * real, 0.5), F.lit(LEAST_SIDE)))
    return boxes.groupBy("sheet").agg(side("x0", "x1").alias("width"), side("y0", "y1").alias("height"))


def foreign_share(sheets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(volume, sheet, n, foreign): distinct keys of sheets (volume, sheet, key), and the share of them that the volume (volume, key) doesn't have."""
    known = wanted.select("volume", F.upper("key").alias("up")).distinct().withColumn("known", F.lit(1))
    each = sheets.select("volume", "sheet", "key").distinct().withColumn("up", F.upper("key")).join(known, ["volume", "up"], "left")
    return each.groupBy("volume", "sheet").agg(F.count("*").alias("n"), F.avg(F.col("known").isNull().cast("double")).alias("foreign"))


def redundant_sheets(sheets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(volume, sheet): key maps that share most keys with another that has far fewer foreign ones. Pairs are judged in order of sheets, those gone no more."""
    shares = foreign_share(sheets, wanted)
    held = sheets.select("volume", "sheet", "key").distinct()
    common = held.join(held.withColumnRenamed("sheet", "other"), ["volume", "key"]).where("sheet < other").groupBy("volume", "sheet", "other").agg(F.count("*").alias("common"))
    of = lambda name: shares.select("volume", F.col("sheet").alias(name), F.col("n").alias(f"{name}_n"), F.col("foreign").alias(f"{name}_foreign"))
    pairs = common.join(of("sheet"), ["volume", "sheet"]).join(of("other"), ["volume", "other"]).join(wanted.select("volume").distinct(), "volume", "left_semi")
    pairs = pairs.where(F.col("common") >= F.least("sheet_n", "other_n") * SAME_KEYS).where(F.abs(F.col("sheet_foreign") - F.col("other_foreign")) >= FOREIGN_GAP)

    def gone(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.sort_values(["sheet", "other"]).itertuples():
            if r.sheet not in out and r.other not in out:
                out.append(r.sheet if r.sheet_foreign > r.other_foreign else r.other)
        return pd.DataFrame({"volume": rows["volume"].iloc[0], "sheet": out})

    return pairs.groupBy("volume").applyInPandas(gone, pairs.select("volume", "sheet").schema)


def label_report(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """(volume, kind, label, n, suggestion): truth labels (volume, file, text) that name no page, pages that none names, and whole pages named twice in a file.

    pages (volume, label, panels, keymap): a key map's own number isn't missing, a split page may stand for each panel.
    """
    texts = labels.select("volume", "file", keys.normalize_label(F.col("text")).alias("label")).where("label <> ''")
    known = pages.select("volume", "label")
    unknown = texts.join(known, ["volume", "label"], "left_anti").groupBy("volume", "label").agg(F.count("*").alias("n")).withColumn("suggestion", keys.without_signs(F.col("label")))
    offered = unknown.join(known.withColumnRenamed("label", "suggestion").withColumn("is", F.lit(True)), ["volume", "suggestion"], "left")
    rows = offered.select("volume", F.lit("unknown").alias("kind"), "label", "n", F.when(F.col("is"), F.col("suggestion")).alias("suggestion"))
    absent = pages.where("NOT keymap").join(texts, ["volume", "label"], "left_anti").select("volume", F.lit("missing"), "label", F.lit(0).cast("long"), F.lit(None).cast("string"))
    twice = texts.join(pages.where("panels = 0"), ["volume", "label"], "left_semi").groupBy("volume", "file", "label").agg(F.count("*").alias("n")).where("n > 1")
    return rows.union(absent).union(twice.select("volume", F.lit("duplicated"), "label", "n", F.lit(None).cast("string")))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets of numbers: label = part, placed by quantity and price."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount").distinct()
    index = F.row_number().over(Window.partitionBy("sheet").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"))
    return lines.select("sheet", index.cast("long").alias("index"), (F.col("l_partkey") % 40).cast("string").alias("label"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_suppkey") % 50 * 9).cast("double").alias("y"))


def sheet_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_pitch(_sheets(spark, sf_dir).select("sheet", "index", "x", "y"))
    return found.select("sheet", F.round("pitch", 6).alias("pitch"))


def sheet_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity(_sheets(spark, sf_dir).select("sheet", "index", "x", "y"))
    return found.groupBy("sheet").agg(F.count("*").alias("pairs"), F.min("i").alias("first_i"), F.max("j").alias("last_j"))


def _citations(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mutual and one-sided key graphs by a rule: keys 1 and 2 apart, and 3 apart."""
    ids = labels.sparkSession.range(40).select(F.col("id").cast("string").alias("key"), "id")
    at = lambda *steps: ids.select("key", F.explode(F.array(*[(F.col("id") + s).cast("string") for s in steps])).alias("other"))
    return at(1, -1, 2, -2), at(3, -3)


def label_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _sheets(spark, sf_dir)
    found = support(labels.select("sheet", "index", F.col("label").alias("key")), neighbours(labels, proximity(labels.select("sheet", "index", "x", "y"))), *_citations(labels))
    return found.select("sheet", "index", "key", "mutual_n", "support", F.size("vouchers").alias("vouchers"))


def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys up to 40 that a sheet lacks and its labels cite."""
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_partkey") % 40).cast("string").alias("label"))
    wanted = spark.range(40).select(F.col("id").cast("string").alias("key"))
    found = gap_repairs(labels, *_citations(labels), wanted)
    return found.groupBy("sheet").agg(F.count("*").alias("n"), F.sum("support").alias("support"), F.min("key").alias("least"))


def key_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered from a supplier's nation fewer times than their size asks for."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    labels = lines.select(F.col("s_nationkey").alias("volume"), (F.col("l_partkey") % 500).alias("label"))
    wanted = table(spark, sf_dir, "part").select((F.col("p_size") % 25).alias("volume"), (F.col("p_partkey") % 500).alias("key"))
    panels = wanted.distinct().withColumn("n", F.col("key") % 40)
    return shortfall(labels, wanted, panels)


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages that claim by number the part's digits, by nation: mutual and one-sided edges."""
    sup = table(spark, sf_dir, "supplier")
    stem = F.concat(F.lit("p"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "s").otherwise(""))
    pages = sup.select((F.col("s_suppkey") % 5).alias("volume"), stem.alias("stem"), "s_suppkey")
    claims = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 1000).cast("string").alias("claim")).distinct()
    directed = resolved_claims(pages, claims.join(pages, F.col("l_suppkey") == F.col("s_suppkey")).select("volume", "stem", "claim"))
    mutual, one = edges_of(directed)
    return mutual.select(F.lit("mutual").alias("kind"), "volume", "a", "b").union(one.select(F.lit("one-sided"), "volume", "a", "b"))


def resolved_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys, cut or lengthened, as reads of the part keys of their volume."""
    known = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("volume"), F.concat(F.col("p_partkey"), F.when(F.col("p_size") < 5, "A").otherwise("")).alias("key"))
    orders = table(spark, sf_dir, "orders")
    text = F.col("o_orderkey").cast("string")
    reads = orders.select((F.col("o_orderkey") % 4).alias("volume"), F.col("o_orderkey").alias("id"), text.alias("digit_text"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.right(text, F.lit(3)), F.lit(" a"))).alias("letter_text"))
    return resolve_page_keys(reads, known)


QUERIES = {f.__name__: f for f in (sheet_pitches, sheet_neighbours, label_support, missing_numbers, key_shortfall, resolved_edges, resolved_reads)}
_SHEETS = """sheets AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount) AS "index", (l_partkey % 40)::VARCHAR AS label, (l_quantity * 10)::DOUBLE AS x, (l_suppkey % 50 * 9)::DOUBLE AS y
  FROM (SELECT DISTINCT l_orderkey AS sheet, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem)),
d AS (SELECT p.sheet, p."index", min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM sheets p JOIN sheets q ON p.sheet = q.sheet AND p."index" <> q."index" GROUP BY ALL),
m AS (SELECT sheet, list_sort(list(d))[(count(*) // 2 + 1)::INT] AS pitch, count(*) AS n FROM d GROUP BY sheet),
pitches AS (SELECT s.sheet, CASE WHEN n >= 3 THEN pitch ELSE 0.0 END AS pitch FROM (SELECT DISTINCT sheet FROM sheets) s LEFT JOIN m ON s.sheet = m.sheet),
touching AS (SELECT p.sheet, p."index" AS i, q."index" AS j FROM sheets p JOIN sheets q ON p.sheet = q.sheet AND p."index" < q."index" JOIN pitches t ON t.sheet = p.sheet AND t.pitch > 0 WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= t.pitch * 1.5)"""
ORACLES = {
    "sheet_pitches": f"WITH {_SHEETS} SELECT sheet, round(pitch, 6) AS pitch FROM pitches",
    "sheet_neighbours": f"WITH {_SHEETS} SELECT sheet, count(*) AS pairs, min(i) AS first_i, max(j) AS last_j FROM touching GROUP BY sheet",
    "label_support": f"""WITH {_SHEETS}, around AS (SELECT DISTINCT t.sheet, t.i, s.label AS beside FROM (SELECT sheet, i, j FROM touching UNION ALL SELECT sheet, j, i FROM touching) t JOIN sheets s ON s.sheet = t.sheet AND s."index" = t.j),
r AS (SELECT s.sheet, s."index", s.label AS key, abs(s.label::INT - a.beside::INT) AS apart FROM sheets s LEFT JOIN around a ON a.sheet = s.sheet AND a.i = s."index")
SELECT sheet, "index", key, count(*) FILTER (apart IN (1, 2)) AS mutual_n, (count(*) FILTER (apart IN (1, 2)) + count(*) FILTER (apart = 3) * 0.25)::DOUBLE AS support, (count(*) FILTER (apart IN (1, 2, 3)))::INT AS vouchers FROM r GROUP BY ALL""",
    "missing_numbers": """WITH l AS (SELECT DISTINCT l_orderkey AS sheet, (l_partkey % 40)::INT AS other FROM lineitem), k AS (SELECT l.sheet, n.k AS key, count(*) FILTER (abs(n.k - other) IN (1, 2)) AS strong, count(*) FILTER (abs(n.k - other) = 3) AS weak
  FROM l JOIN (SELECT unnest(range(40))::INT AS k) n ON abs(n.k - other) <= 3 GROUP BY ALL HAVING count(*) FILTER (n.k = other) = 0)
SELECT sheet, count(*) AS n, sum(strong + weak * 0.25)::DOUBLE AS support, min(key::VARCHAR) AS least FROM k WHERE strong >= 1 AND strong + weak * 0.25 >= 1.5 GROUP BY sheet""",
    "key_shortfall": """WITH p AS (SELECT s_nationkey AS volume, l_partkey % 500 AS key, count(*) AS placed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), w AS (SELECT DISTINCT p_size % 25 AS volume, p_partkey % 500 AS key FROM part)
SELECT w.volume, w.key FROM w LEFT JOIN p ON p.volume = w.volume AND p.key = w.key WHERE coalesce(placed, 0) < w.key % 40""",
    "resolved_edges": """WITH p AS (SELECT s_suppkey % 5 AS volume, s_suppkey, 'p' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN 's' ELSE '' END AS stem FROM supplier),
c AS (SELECT DISTINCT volume, stem AS a, l_partkey % 1000 AS n FROM lineitem JOIN p ON l_suppkey = s_suppkey),
e AS (SELECT DISTINCT c.volume, c.a, p.stem AS b FROM c JOIN p ON p.volume = c.volume AND p.s_suppkey = c.n WHERE c.a <> p.stem)
SELECT CASE WHEN f.a IS NULL THEN 'one-sided' ELSE 'mutual' END AS kind, e.volume, e.a, e.b FROM e LEFT JOIN e f ON f.volume = e.volume AND f.a = e.b AND f.b = e.a WHERE f.a IS NULL OR e.a < e.b""",
    "resolved_reads": """WITH k AS (SELECT DISTINCT p_partkey % 4 AS volume, p_partkey || CASE WHEN p_size < 5 THEN 'A' ELSE '' END AS key, p_partkey::VARCHAR AS digits, p_size >= 5 AND p_partkey >= 100 AS whole FROM part),
r AS (SELECT o_orderkey % 4 AS volume, o_orderkey AS id, o_orderkey::VARCHAR AS d, CASE WHEN o_orderkey % 5 = 0 THEN right(o_orderkey::VARCHAR, 3) || 'A' END AS l FROM orders),
s AS (SELECT id, key, 0 AS rank, 'lettered' AS method FROM r JOIN k ON r.volume = k.volume AND l = key
  UNION ALL SELECT id, key, 1, 'exact' FROM r JOIN k ON r.volume = k.volume AND d = key UNION ALL SELECT id, key, 2, 'number' FROM r JOIN k ON r.volume = k.volume AND d = digits
  UNION ALL SELECT id, key, 3, 'suffix' FROM r JOIN k ON r.volume = k.volume AND whole AND length(d) >= 3 AND length(key) > length(d) AND key LIKE '%' || d
  UNION ALL SELECT id, key, 4, 'embedded' FROM r JOIN k ON r.volume = k.volume AND whole AND length(key) < length(d) AND d LIKE '%' || key || '%'),
u AS (SELECT id, rank, min(key) AS key, min(method) AS method FROM s GROUP BY id, rank HAVING count(DISTINCT key) = 1)
SELECT id, key, method FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1""",
}
