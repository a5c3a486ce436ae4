"""Decision rules on fitted poses: signals, verdicts, energies and the choices between an incumbent and its challengers.

The rules are column expressions. A record is a struct of incumbent and candidates (see sources.sidecars);
a pose is an affine struct as in functions.geo.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions import geo
from plumbline.operators.adjacency import upper_median
from plumbline.session import kept, table

#: Fixed values of the gates: control points up to which a fit may be demoted, degrees and log of scale it may be off, metres its stamps may lie apart.
GATE_POINTS, GATE_TURN, GATE_SCALE, STAMP_M = 2, 15.0, 0.2, 100.0
#: Fixed values of the energy: weights of name, containment, prior residual, key-map distance (and its clamp), rungs, notes, ambiguity, contradiction, entry, stamps (and their clamp), overlap.
W_NAME, W_CONTAIN, W_PRIOR, W_KEYMAP, KEYMAP_CLAMP, W_RUNG, W_NOTE, W_AMBIGUOUS, W_CONTRADICTED, W_ENTRY, W_STAMP, STAMP_CLAMP, W_OVERLAP = 1.0, 0.3, 0.1, 0.05, 3.0, 0.15, 0.30, 0.5, 0.5, 1.25, 0.30, 2.0, 3.0
OVERLAP_SOFT, OVERLAP_RANGE, NEAR_RUNG = 0.15, 0.35, 0.25
#: Counts that a cell's table of scales by place may hold.
CUBE = 2_000_000
#: Fixed values of choices: margin of a distinct rival, metres and degrees that make it distinct, feet from which poses disagree, verification from which an incumbent is defended,
#: margin and least verification and control points for refinement.
GATE_MARGIN, DISTINCT_M, DISTINCT_DEG, DISAGREE_FT, DEFENSIBLE, REFINE_MARGIN, REFINE_LEAST, REFINE_POINTS = 0.25, 100.0, 10.0, 100.0, 0.1, 0.05, 0.0, 2
#: Fixed values of rung flips: the band of doubled scales, of notes kept, margin, name floor, least score.
RUNG_UP, NOTE_BAND, RUNG_MARGIN, RUNG_NAME, RUNG_SCORE = (1.7, 2.3), (0.80, 1.25), 0.1, -0.10, 0.9
#: Fixed values of scale notes: pages that calibrate, the default of pixels an inch, the rung of the median page, the band of plausible calibrations; the window of a rung.
CALIBRATION_PAGES, DEFAULT_INCH, MEDIAN_FT, PLAUSIBLE_INCH, RUNG_WINDOW = 3, 62.5, 50, (45.0, 100.0), math.log2(1.15)
#: Fixed values of the search radius: residuals that calibrate it, its margin and least.
RADIUS_PAGES, RADIUS_MARGIN, RADIUS_LEAST = 5, 100.0, 150.0


def hard_signal(points: Column, theta: Column, log_scale: Column, median_theta: Column, median_log_scale: Column) -> Column:
    """What licenses a demotion: few control points, a turn that is no quarter, or a scale (natural log) that is no rung off the median's; null if nothing does."""
    turn = F.abs(F.pmod(theta - median_theta + 45, F.lit(90.0)) - 45)
    off = log_scale - median_log_scale
    scale = F.abs(off - F.rint(off / math.log(2)) * math.log(2))
    found = F.when(points <= GATE_POINTS, F.concat(F.lit("gcps="), points.cast("string")))
    found = found.when(turn > GATE_TURN, F.concat(F.lit("rot_dev="), F.bround(turn, 0).cast("int").cast("string"), F.lit("deg")))
    return found.when(scale > GATE_SCALE, F.concat(F.lit("scale_dev="), F.format_string("%.2f", scale)))


def stamp_bar(log_scale_a: Column, log_scale_b: Column, median: Column) -> Column:
    """Metres that two sheets' stamps may lie apart: more at coarser scales."""
    return STAMP_M * F.greatest(F.lit(1.0), F.exp(F.greatest(log_scale_a, log_scale_b) - median))


def stamp_world(affine: Column, x_share: Column, y_share: Column, width: Column, height: Column, panel: Column, page_width: Column, page_height: Column) -> tuple[Column, Column]:
    """The place of a claim at shares of its sheet (width, height), on a page that is the whole sheet or a panel (x0, y0, x1, y1) of it."""
    x, y = x_share * width, y_share * height
    inside = panel.isNotNull() & (panel["x1"] > panel["x0"]) & (panel["y1"] > panel["y0"])
    px = F.when(inside, (x - panel["x0"]) * page_width / F.nullif(panel["x1"] - panel["x0"], F.lit(0.0))).otherwise(x)
    py = F.when(inside, (y - panel["y0"]) * page_height / F.nullif(panel["y1"] - panel["y0"], F.lit(0.0))).otherwise(y)
    return geo.apply_affine(affine, px, py)


def contradictions(stamps: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(volume, a, b, distance, bad) of edges (volume, a, b) whose both pages stamp the other: stamps (volume, page, other, lon, lat), pages (volume, page, log_scale)."""
    medians = pages.groupBy("volume").agg(upper_median("log_scale").alias("median"))
    side = lambda page, other, lon, lat: stamps.select("volume", F.col("page").alias(page), F.col("other").alias(other), F.col("lon").alias(lon), F.col("lat").alias(lat))
    scale = lambda page: pages.select("volume", F.col("page").alias(page), F.col("log_scale").alias(f"scale_{page}"))
    met = edges.join(side("a", "b", "lon_a", "lat_a"), ["volume", "a", "b"]).join(side("b", "a", "lon_b", "lat_b"), ["volume", "a", "b"])
    near = met.groupBy("volume", "a", "b").agg(F.min(geo.haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))).alias("distance"))
    near = near.join(scale("a"), ["volume", "a"]).join(scale("b"), ["volume", "b"]).join(medians, "volume")
    return near.select("volume", "a", "b", "distance", (F.col("distance") > stamp_bar(F.col("scale_a"), F.col("scale_b"), F.col("median"))).alias("bad"))


def select_score(verification: Column, name: Column, containment: Column, residual: Column) -> Column:
    """A candidate's rank: its verification with bonuses for names, its region and its rotation's prior; without a finite verification the least."""
    score = verification + F.coalesce(W_NAME * name, F.lit(0.0)) + F.coalesce(W_CONTAIN * containment, F.lit(0.0)) + F.coalesce(W_PRIOR * F.greatest(F.lit(-1.0), 1 - residual), F.lit(0.0))
    return F.when(verification.isNull() | F.isnan(verification) | (F.abs(verification) == float("inf")), float("-inf")).otherwise(score)


def unary_terms(verification: Column, name: Column, containment: Column, placed: Column, published: Column, points: Column, key_map_m: Column, radius_m: Column, rung: Column, note_ratio: Column, ambiguous: Column, contradicted: Column) -> dict[str, Column]:
    """The terms of a pose's own energy. rung: log2 of its scale less the family's; null terms don't apply."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    noted = note_ratio.isNotNull() & ~note_ratio.between(*NOTE_BAND)
    by_note = F.when(F.abs(rung - F.log2(note_ratio)) < NEAR_RUNG, 0.0).otherwise(W_NOTE)
    by_rung = F.when(F.abs(rung - F.rint(rung)) < NEAR_RUNG, 0.0).otherwise(W_RUNG)
    share = key_map_m / F.when(radius_m > 0, radius_m)
    return {
        "evidence": -(zero(verification) + W_NAME * zero(name) + W_CONTAIN * zero(containment)),
        "entry": F.when(~placed, W_ENTRY),
        "keep_prior": F.when(published, -geo.keep_prior(points, verification)),
        "keymap": W_KEYMAP * F.when(share.isNotNull(), F.least(F.lit(KEYMAP_CLAMP), share * share)),
        "rung": F.when(rung.isNotNull(), F.when(noted, by_note).otherwise(by_rung)),
        "ambiguity": F.when(ambiguous, W_AMBIGUOUS),
        "contradicted": F.when(contradicted, W_CONTRADICTED),
    }


def total(terms: Iterable[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + F.coalesce(t, F.lit(0.0))
    return out


def stamp_energy(distance: Column, bar: Column) -> Column:
    return W_STAMP * F.least(F.lit(STAMP_CLAMP), (distance / bar) * (distance / bar))


def overlap_energy(share: Column, soft: Column) -> Column:
    return W_OVERLAP * geo.overlap_share(share, soft, soft + OVERLAP_RANGE)


def overlap_soft(shares: DataFrame) -> DataFrame:
    """(volume, soft): where a volume's overlaps (volume, share) start to cost: their ninth decile, or the fixed least."""
    return shares.groupBy("volume").agg(F.greatest(F.lit(OVERLAP_SOFT), F.percentile("share", 0.9)).alias("soft"))


def rmse_ft(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Root mean square of the feet between two poses over a grid of the sheet."""
    def square(p: Column) -> Column:
        (xa, ya), (xb, yb) = geo.apply_affine(a, p[0], p[1]), geo.apply_affine(b, p[0], p[1])
        d = geo.haversine_m(xa, ya, xb, yb) * geo.FEET
        return d * d

    grid = geo.sample_grid(width, height)
    return F.sqrt(F.aggregate(grid, F.lit(0.0), lambda t, p: t + square(p)) / F.size(grid))


def ranked(candidates: Column) -> Column:
    """Candidates by score, best first, those without one last; of equals as they stand."""
    keyed = F.transform(candidates, lambda c, i: F.struct(c["select_score"].isNull().alias("none"), (-c["select_score"]).alias("less"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def distinct_margin(candidates: Column) -> Column:
    """The first candidate's score less that of the first one at another place or turn; infinite without one, null without a score."""
    top = F.get(candidates, F.lit(0))
    apart = lambda c: geo.haversine_m(top["lon"], top["lat"], c["lon"], c["lat"]) > DISTINCT_M
    turned = lambda c: F.abs(geo.wrap_degrees(c["theta_deg"] - top["theta_deg"])) > DISTINCT_DEG
    rivals = F.filter(F.slice(candidates, F.lit(2), F.greatest(F.size(candidates), F.lit(0))), lambda c: c["select_score"].isNotNull() & (apart(c) | turned(c)))
    return F.when(top["select_score"].isNotNull(), F.coalesce(top["select_score"] - F.get(rivals, F.lit(0))["select_score"], F.lit(float("inf"))))


def uncorroborated_margin(candidates: Column, vouched) -> Column:
    """The first candidate's score less the best one's that nothing vouches for."""
    rivals = F.filter(F.slice(candidates, F.lit(2), F.greatest(F.size(candidates), F.lit(0))), lambda c: c["select_score"].isNotNull() & ~vouched(c))
    return F.coalesce(F.get(candidates, F.lit(0))["select_score"] - F.array_max(F.transform(rivals, lambda c: c["select_score"])), F.lit(float("inf")))


def refines(incumbent: Column, top: Column, disagreement: Column, margin: float = REFINE_MARGIN) -> Column:
    """Whether a candidate takes over as a more precise pose of the same place."""
    held = F.coalesce(incumbent["effective_gcps"] >= REFINE_POINTS, F.lit(True)) & top["select_score"].isNotNull()
    better = (top["verification"] > REFINE_LEAST) & (top["verification"] > incumbent["verification"] + margin)
    return F.coalesce(held & better & (disagreement < DISAGREE_FT), F.lit(False))


def challenges(incumbent: Column, top: Column, margin: Column, disagreement: Column, gate: float) -> Column:
    """Whether a candidate at another place replaces an incumbent that can't be defended."""
    named = F.coalesce(top["name"], F.lit(0.0)) >= F.coalesce(incumbent["name"], F.lit(0.0))
    better = (incumbent["verification"] < DEFENSIBLE) & (top["verification"] > incumbent["verification"])
    return F.coalesce((top["select_score"] >= gate) & (margin >= GATE_MARGIN) & (disagreement >= DISAGREE_FT) & better & named, F.lit(False))


def rung_flip(incumbent: Column, candidates: Column, note_ratio: Column) -> Column:
    """The place of the candidate at twice the incumbent's scale (or at half, where a printed note says so) that verifies best; null without one."""
    condemned = F.coalesce(~note_ratio.between(1 / NOTE_BAND[1], 1 / NOTE_BAND[0]), F.lit(False))

    def fits(c: Column) -> Column:
        ratio = c["scale"] / incumbent["scale"]
        endorsed = condemned & (ratio / note_ratio).between(*NOTE_BAND)
        band = ratio.between(*RUNG_UP) | (ratio.between(1 / RUNG_UP[1], 1 / RUNG_UP[0]) & F.coalesce(endorsed, F.lit(False)))
        named = F.coalesce(c["name"] - incumbent["name"] >= RUNG_NAME, F.lit(True))
        return F.coalesce(band & (c["select_score"] >= RUNG_SCORE) & (c["verification"] - incumbent["verification"] >= RUNG_MARGIN) & named, F.lit(False))

    kept = F.filter(F.transform(candidates, lambda c, i: F.struct((-c["verification"]).alias("less"), i.alias("i"), fits(c).alias("fits"))), lambda s: s["fits"])
    return F.when(incumbent["scale"] > 0, F.array_min(kept)["i"])


def ambiguous(options: DataFrame) -> DataFrame:
    """(page, option, ambiguous) of options (page, option, lon, lat, evidence, published): unpublished ones that a rival at another place ties."""
    rival = options.select("page", F.col("option").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("evidence").alias("evidence2")).dropna()
    met = options.where(~F.col("published") & F.col("evidence").isNotNull()).join(rival, "page").where("option <> other").where(F.col("evidence2") >= F.col("evidence") - GATE_MARGIN)
    tied = met.where(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) > DISTINCT_M).select("page", "option").distinct()
    return options.select("page", "option").join(tied.withColumn("tied", F.lit(True)), ["page", "option"], "left").select("page", "option", F.coalesce("tied", F.lit(False)).alias("ambiguous"))


def shared_points(options: DataFrame, near: DataFrame) -> DataFrame:
    """(page, option, points): options (page, option, points, carries) with the most control points of those within reach (page, option, other) that carry any."""
    given = near.join(options.where("carries").select("page", F.col("option").alias("other"), F.col("points").alias("given")), ["page", "other"])
    most = given.where("option <> other").groupBy("page", "option").agg(F.max("given").alias("given"))
    return options.join(most, ["page", "option"], "left").select("page", "option", F.greatest("points", F.coalesce("given", F.lit(0))).alias("points"))


def note_verdicts(pages: DataFrame) -> DataFrame:
    """(volume, page, verdict, ratio) of pages (volume, page, px_per_ft, note): whether a fitted scale fits the note printed on the sheet.

    A volume's pixels an inch are the median over noted pages, if there are enough; else what the median
    scale makes of the usual note, if that is plausible; else the default. Scales off by a rung are kept.
    """
    inch = F.percentile(F.when((F.col("px_per_ft") > 0) & F.col("note").isNotNull(), F.col("px_per_ft") * F.col("note")), 0.5)
    n = F.count_if((F.col("px_per_ft") > 0) & F.col("note").isNotNull())
    rung = F.percentile("px_per_ft", 0.5) * MEDIAN_FT
    volumes = pages.groupBy("volume").agg(F.when(n >= CALIBRATION_PAGES, inch).when(rung.between(*PLAUSIBLE_INCH), rung).otherwise(DEFAULT_INCH).alias("inch"))
    each = pages.where("note IS NOT NULL").join(volumes, "volume").withColumn("ratio", F.col("px_per_ft") / geo.expected_px_per_ft(F.col("inch"), F.col("note")))
    keep = F.col("ratio").between(*NOTE_BAND) | ~geo.is_scale_outlier(F.col("ratio"), geo.SCALE_BANDS[1:])
    return each.select("volume", "page", F.when(keep, "keep").otherwise("drop").alias("verdict"), "ratio")


def note_ratios(pages: DataFrame) -> DataFrame:
    """(volume, page, ratio): what a sheet's note makes of its scale (volume, page, scale, note), by the upper median of scale a foot; volumes of three noted pages or more."""
    noted = pages.where("note IS NOT NULL AND scale IS NOT NULL")
    units = noted.groupBy("volume").agg(upper_median(F.col("scale") / F.col("note")).alias("unit"), F.count("*").alias("n")).where("n >= 3")
    return noted.join(units, "volume").select("volume", "page", (F.col("unit") * F.col("note") / F.col("scale")).alias("ratio"))


def _reach(x: np.ndarray, u: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """From where to where of u (sorted) each x reaches by d."""
    each, at = np.unique(x, return_inverse=True)
    met = np.abs(each[:, None] - u) <= d
    low = met.argmax(axis=1)
    return low[at], (low + met.sum(axis=1))[at]


def _weighted_medians(x: np.ndarray, y: np.ndarray, own: np.ndarray, known: np.ndarray, u: np.ndarray, v: np.ndarray, scale: np.ndarray, weight: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, median) of the scales (sorted, each weight times) within dx and dy of each place, but for one of its own scale, if known.

    Where places lie on few lines and scales are few, they are counted by sums over corners of boxes, else one by one.
    """
    n, median = np.zeros(len(x), np.int64), np.full(len(x), np.nan)
    if not len(u) or not len(x):
        return n, median
    (us, ui), (vs, vi), (values, si) = (np.unique(k, return_inverse=True) for k in (u, v, scale))
    cubed = (len(us) + 1) * (len(vs) + 1) * len(values) <= CUBE
    if cubed:
        cube = np.zeros((len(us) + 1, len(vs) + 1, len(values)), np.int64)
        np.add.at(cube, (ui + 1, vi + 1, si), weight)
        cube = cube.cumsum(axis=0).cumsum(axis=1).cumsum(axis=2)
        (x0, x1), (y0, y1) = _reach(x, us, dx), _reach(y, vs, dy)
    else:
        values = scale
    step = max(1, 200_000 // len(values))
    for i in range(0, len(x), step):
        s = slice(i, i + step)
        if cubed:
            upto = cube[x1[s], y1[s]] - cube[x0[s], y1[s]] - cube[x1[s], y0[s]] + cube[x0[s], y0[s]]
        else:
            upto = np.cumsum(((np.abs(x[s, None] - u) <= dx) & (np.abs(y[s, None] - v) <= dy)) * weight, axis=1)
        sure = known[s]
        mine = np.where(sure, np.searchsorted(values, own[s]), len(values))  # the first of the own scale; places from there on lie one further
        n[s] = upto[:, -1] - sure
        middle = []
        for k in ((n[s] - 1) // 2, n[s] // 2):  # counted from 0, of what is left
            at = (upto <= k[:, None]).sum(axis=1)
            at = np.where(at >= mine, (upto <= k[:, None] + sure[:, None]).sum(axis=1), at)
            middle.append(values[np.minimum(at, len(values) - 1)])
        median[s] = np.where(n[s] > 0, 0.5 * middle[0] + 0.5 * middle[1], np.nan)
    return n, median


def near_scales(pages: DataFrame, width: float, height: float) -> DataFrame:
    """(page, n, median): fitted scales of pages (page, lon, lat, scale) within a page and a half of each (its size in degrees).

    Pages meet in cells of that size; those of one place and scale as one, with their number.
    """
    dx, dy = 1.5 * width, 1.5 * height
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asked = pages.where("page IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL").select("page", *[F.col(c).cast("double").alias(c) for c in ("lon", "lat", "scale")])
    asked = asked.withColumn("cx", F.floor(F.col("lon") / dx)).withColumn("cy", F.floor(F.col("lat") / dy))
    alike = kept(asked.groupBy("lon", "lat", "scale", "cx", "cy").agg(F.count("*").alias("weight"), F.collect_list("page").alias("pages")).withColumn("known", F.col("scale").isNotNull()), "near-scales")
    other = alike.where("known").drop("pages", "known").withColumn("sx", step).withColumn("sy", step)
    other = other.select("lon", "lat", "scale", "weight", (F.col("cx") + F.col("sx")).alias("cx"), (F.col("cy") + F.col("sy")).alias("cy"))

    def made(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("scale", kind="stable")
        n, median = _weighted_medians(*(a[c].to_numpy(float) for c in ("lon", "lat", "scale")), a["known"].to_numpy(bool), *(b[c].to_numpy(float) for c in ("lon", "lat", "scale")), b["weight"].to_numpy(np.int64), dx, dy)
        return pd.DataFrame({"pages": a["pages"], "n": n, "median": median})[n > 0]

    met = alike.groupBy("cx", "cy").cogroup(other.groupBy("cx", "cy")).applyInPandas(made, T.StructType([alike.schema["pages"], T.StructField("n", T.LongType()), T.StructField("median", T.DoubleType())]))
    return met.select(F.explode("pages").alias("page"), "n", "median")


def rung_multiplier(reference: Column, n: Column, median: Column) -> Column:
    """Half, same or double scale, as the neighbours' median has it; same with fewer than two of them or between rungs."""
    off = F.log2(median / reference)
    rung = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(off)))
    return F.when((n >= 2) & (F.abs(off - rung) <= RUNG_WINDOW), F.pow(F.lit(2.0), rung)).otherwise(1.0)


def scale_corroborated(scale: Column, n: Column, median: Column) -> Column:
    return F.coalesce((n >= 2) & (scale / median).between(*geo.SCALE_BANDS[0]), F.lit(False))


def search_radius(residuals: DataFrame, locator: float) -> DataFrame:
    """(volume, radius, source): how far to look around a key map's place, by fitted pages' residuals (volume, metres)."""
    calibrated = F.greatest(F.lit(RADIUS_LEAST), F.least(F.percentile("metres", 0.9) + RADIUS_MARGIN, F.lit(locator)))
    enough = F.count("metres") >= RADIUS_PAGES
    return residuals.groupBy("volume").agg(F.when(enough, calibrated).otherwise(locator).alias("radius"), F.when(enough, "calibrated").otherwise("locator").alias("source"))


def name_alignment(hits: DataFrame, decay_m: float = 25.0) -> DataFrame:
    """(page, score, labels): how well labels (page, label, metres to the street they name, null if too far or turned) stand on their streets."""
    return hits.groupBy("page").agg((F.coalesce(F.sum(F.exp(-F.col("metres") / decay_m)), F.lit(0.0)) / (F.count("*") + 2)).alias("score"), F.count("*").alias("labels"))


def pose_medians(poses: DataFrame) -> DataFrame:
    """(volume, scale, theta): median of scales and mean direction of poses (volume, scale, theta in degrees)."""
    angle = F.radians("theta")
    return poses.groupBy("volume").agg(F.percentile("scale", 0.5).alias("scale"), F.degrees(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))).alias("theta"))


def turn_votes(pages: DataFrame, near: DataFrame, limit: float) -> DataFrame:
    """(page, as_is, turned): neighbours (page, other) whose rotation is within limit degrees of the page's, and of its opposite; pages (page, theta)."""
    met = near.join(pages, "page").join(pages.select(F.col("page").alias("other"), F.col("theta").alias("beside")), "other")
    off = F.abs(geo.wrap_degrees(F.col("beside") - F.col("theta")))
    return met.groupBy("page").agg(F.count_if(off <= limit).alias("as_is"), F.count_if(180 - off <= limit).alias("turned"))


def outcome(deltas: DataFrame) -> DataFrame:
    """(volume, delta, better, worse): what replacing poses does to a score: changes of the band (1 good, -1 disaster) by land, of rows (volume, before, after, land)."""
    worth = lambda c: F.when(F.col(c) <= 25, 1.0).when(F.col(c) >= 200, -1.0).otherwise(0.0)
    change = worth("after") - worth("before")
    return deltas.groupBy("volume").agg(F.sum(change * F.col("land")).alias("delta"), F.count_if(change > 0).alias("better"), F.count_if(change < 0).alias("worse"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fitted pages: volume = supplier, page = line."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("volume"), "l_orderkey", "l_partkey", "l_linenumber", (c("l_partkey") % 7).cast("int").alias("points"), (c("l_partkey") * 37 % 360).cast("double").alias("theta"),
        F.ln(c("l_quantity")).alias("log_scale"), (c("l_discount") * 20 - 0.5).alias("verification"), (c("l_tax") * 10).alias("name"), c("l_quantity").alias("q"), c("l_extendedprice").alias("price"),
    )


def fit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demotion signals against the volume's upper medians, counted by kind."""
    p = _pages(spark, sf_dir)
    m = p.groupBy("volume").agg(upper_median("theta").alias("mt"), upper_median("log_scale").alias("ms"))
    signal = hard_signal(F.col("points"), F.col("theta"), F.col("log_scale"), F.col("mt"), F.col("ms"))
    return p.join(m, "volume").groupBy("volume").agg(*[F.count_if(signal.startswith(k)).alias(k) for k in ("gcps", "rot_dev", "scale_dev")], F.count_if(signal.isNull()).alias("sound"))


def pose_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unary energies of each page as a pose, summed by volume in millionths."""
    c, p = F.col, _pages(spark, sf_dir)
    note = F.when(c("l_partkey") % 4 == 0, c("l_linenumber") / 4)
    terms = unary_terms(
        F.when(c("points") != 3, c("verification")), c("name"), c("q") / 50, c("l_partkey") % 3 != 0, c("l_partkey") % 2 == 0, c("points"), c("q") * 10, F.lit(120.0), c("log_scale") / math.log(2) - 4, note,
        c("l_partkey") % 5 == 0, c("l_partkey") % 11 == 0,
    )
    micro = lambda x: F.sum(F.round(F.coalesce(x, F.lit(0.0)) * 1e6).cast("long"))
    return p.groupBy("volume").agg(micro(total(terms.values())).alias("energy"), *[micro(t).alias(k) for k, t in terms.items()])


def scale_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on lines' scales by notes that their parts carry."""
    c, p = F.col, _pages(spark, sf_dir)
    note = F.when(c("l_partkey") % 10 < 4, 25 * (1 + c("l_partkey") % 4))
    found = note_verdicts(p.select("volume", F.struct("l_orderkey", "l_partkey", "l_linenumber").alias("page"), (c("q") / 20).alias("px_per_ft"), note.alias("note")))
    return found.groupBy("volume", "verdict").agg(F.count("*").alias("n"), F.round(F.min("ratio"), 6).alias("least"), F.round(F.max("ratio"), 6).alias("most"))


def pose_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first line as incumbent and its lines by score as candidates: margin, refinement, challenge and rung flip."""
    c = F.col
    cand = F.struct(
        (c("verification") + c("name")).alias("select_score"), "verification", "name", (c("q") / 10).alias("scale"), (c("price") / 1e6).alias("lon"), (c("q") / 1000).alias("lat"), c("theta").alias("theta_deg"),
        "l_partkey", "volume", c("points").alias("effective_gcps"),
    )
    rows = _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(cand).alias("cs"))
    by = lambda f: F.transform(F.array_sort(F.transform("cs", lambda x: F.struct(f(x).alias("k"), x["l_partkey"].alias("p"), x["volume"].alias("s"), x["scale"].alias("q"), x.alias("x")))), lambda s: s["x"])
    rows = rows.select("l_orderkey", by(lambda x: -x["select_score"]).alias("cs"), F.get(by(lambda x: x["l_partkey"]), F.lit(0)).alias("inc")).withColumn("top", F.get("cs", F.lit(0)))
    margin, far = distinct_margin(c("cs")), F.hypot(c("top.lon") - c("inc.lon"), c("top.lat") - c("inc.lat")) * 10_000
    return rows.select(
        "l_orderkey", F.round(F.when(margin < float("inf"), margin), 6).alias("margin"), refines(c("inc"), c("top"), far).cast("int").alias("refines"),
        challenges(c("inc"), c("top"), margin, far, 0.8).cast("int").alias("challenges"), rung_flip(c("inc"), c("cs"), F.lit(None).cast("double")).alias("flip"),
    )


def local_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages on a grid: neighbours' scales and the rung they suggest."""
    k = F.col("c_custkey")
    pages = table(spark, sf_dir, "customer").select(k.alias("page"), (k * 53 % 1000 / 10.0).alias("lon"), (k * 17 % 997 / 10.0).alias("lat"), (F.pow(F.lit(2.0), k % 3) * (1 + k % 7 / 100.0)).alias("scale"))
    near = near_scales(pages, 2.0, 2.0)
    found = pages.join(near, "page", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select("page", "n", F.round("median", 6).alias("median"), F.coalesce(rung_multiplier(F.lit(2.0), F.col("n"), F.col("median")), F.lit(1.0)).alias("rung"), scale_corroborated(F.col("scale"), F.col("n"), F.col("median")).cast("int").alias("corroborated"))


def placement_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("volume", (F.col("q") * 5).alias("before"), (F.col("l_partkey") % 260).cast("double").alias("after"), (F.col("l_linenumber") / 8).alias("land"))
    return outcome(p).select("volume", F.round("delta", 6).alias("delta"), "better", "worse")


QUERIES = {f.__name__: f for f in (fit_signals, pose_energies, scale_notes, pose_choices, local_scales, placement_outcome)}
_PAGES = """p AS (SELECT l_suppkey AS volume, l_orderkey, l_partkey, l_linenumber, l_partkey % 7 AS points, (l_partkey * 37 % 360)::DOUBLE AS theta, ln(l_quantity) AS log_scale, l_discount * 20 - 0.5 AS verification,
  l_tax * 10 AS name, l_quantity AS q, l_extendedprice AS price FROM lineitem)"""
ORACLES = {
    "fit_signals": f"""WITH {_PAGES}, m AS (SELECT volume, list_sort(list(theta))[(count(*) // 2 + 1)::INT] AS mt, list_sort(list(log_scale))[(count(*) // 2 + 1)::INT] AS ms FROM p GROUP BY volume),
d AS (SELECT p.volume, points, abs(((theta - mt + 45) % 90 + 90) % 90 - 45) AS turn, abs((log_scale - ms) - round_even((log_scale - ms) / ln(2), 0) * ln(2)) AS off FROM p JOIN m USING (volume)),
k AS (SELECT volume, CASE WHEN points <= 2 THEN 1 WHEN turn > 15 THEN 2 WHEN off > 0.2 THEN 3 ELSE 4 END AS k FROM d)
SELECT volume, count(*) FILTER (k = 1) AS gcps, count(*) FILTER (k = 2) AS rot_dev, count(*) FILTER (k = 3) AS scale_dev, count(*) FILTER (k = 4) AS sound FROM k GROUP BY volume""",
    "pose_energies": f"""WITH {_PAGES}, v AS (SELECT *, CASE WHEN points <> 3 THEN verification END AS ver, log_scale / ln(2) - 4 AS rung, CASE WHEN l_partkey % 4 = 0 THEN l_linenumber / 4 END AS note FROM p),
t AS (SELECT volume, -(coalesce(ver, 0) + name + 0.3 * (q / 50)) AS evidence, CASE WHEN l_partkey % 3 = 0 THEN 1.25 ELSE 0 END AS entry,
  CASE WHEN l_partkey % 2 = 0 THEN -(CASE WHEN points <= 1 THEN CASE WHEN coalesce(ver >= 0, false) THEN 0.69 ELSE 0 END WHEN points <= 3 THEN CASE WHEN coalesce(ver >= 0, false) THEN 0.68 ELSE 0.25 END ELSE CASE WHEN coalesce(ver >= 0, false) THEN 0.94 ELSE 0.57 END END) ELSE 0 END AS keep_prior,
  0.05 * least(3.0, (q * 10 / 120.0) * (q * 10 / 120.0)) AS keymap,
  CASE WHEN note IS NOT NULL AND NOT (note BETWEEN 0.8 AND 1.25) THEN CASE WHEN abs(rung - log2(note)) < 0.25 THEN 0 ELSE 0.3 END ELSE CASE WHEN abs(rung - round_even(rung, 0)) < 0.25 THEN 0 ELSE 0.15 END END AS rung,
  CASE WHEN l_partkey % 5 = 0 THEN 0.5 ELSE 0 END AS ambiguity, CASE WHEN l_partkey % 11 = 0 THEN 0.5 ELSE 0 END AS contradicted FROM v)
SELECT volume, {", ".join(f"sum(round(({e})::DOUBLE * 1000000)::BIGINT)::BIGINT AS {n}" for n, e in [("energy", "evidence + entry + keep_prior + keymap + rung + ambiguity + contradicted"), *((x, x) for x in ("evidence", "entry", "keep_prior", "keymap", "rung", "ambiguity", "contradicted"))])} FROM t GROUP BY volume""",
    "scale_notes": f"""WITH {_PAGES}, n AS (SELECT volume, q / 20 AS px, CASE WHEN l_partkey % 10 < 4 THEN 25 * (1 + l_partkey % 4) END AS note FROM p),
c AS (SELECT volume, CASE WHEN count(note) >= 3 THEN median(px * note) WHEN median(px) * 50 BETWEEN 45 AND 100 THEN median(px) * 50 ELSE 62.5 END AS inch FROM n GROUP BY volume),
r AS (SELECT n.volume, px / (inch / note) AS ratio FROM n JOIN c USING (volume) WHERE note IS NOT NULL)
SELECT volume, CASE WHEN ratio BETWEEN 0.8 AND 1.25 OR ratio BETWEEN 0.4 AND 0.6 OR ratio BETWEEN 1.8 AND 2.2 THEN 'keep' ELSE 'drop' END AS verdict, count(*) AS n, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most FROM r GROUP BY 1, 2""",
    "pose_choices": f"""WITH {_PAGES}, c AS (SELECT *, verification + name AS ss, q / 10 AS scale, price / 1e6 AS lon, q / 1000 AS lat, row_number() OVER (PARTITION BY l_orderkey ORDER BY -(verification + name), l_partkey, volume, q, verification, price) AS rk,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, volume, q, verification + name, verification, name, price) AS first_rk FROM p),
j AS (SELECT c.*, t.ss AS tss, t.verification AS tv, t.name AS tn, t.lon AS tlon, t.lat AS tlat, t.theta AS tt, i.verification AS iv, i.name AS iname, i.scale AS iscale, i.points AS ip, sqrt((t.lon - i.lon) * (t.lon - i.lon) + (t.lat - i.lat) * (t.lat - i.lat)) * 10000 AS away
  FROM c JOIN c t ON t.l_orderkey = c.l_orderkey AND t.rk = 1 JOIN c i ON i.l_orderkey = c.l_orderkey AND i.first_rk = 1),
d AS (SELECT *, rk > 1 AND (2 * (20925524e0 / 3.280839895e0) * asin(sqrt(least(1, pow(sin(radians(lat - tlat) / 2), 2) + cos(radians(tlat)) * cos(radians(lat)) * pow(sin(radians(lon - tlon) / 2), 2)))) > 100 OR abs((theta - tt + 540) % 360 - 180) > 10) AS rival,
  scale / iscale BETWEEN 1.7 AND 2.3 AND ss >= 0.9 AND verification - iv >= 0.1 AND name - iname >= -0.1 AS flips FROM j),
m AS (SELECT l_orderkey, any_value(tss) - max(ss) FILTER (rival) AS margin, any_value(tv) AS tv, any_value(tn) AS tn, any_value(tss) AS tss, any_value(iv) AS iv, any_value(iname) AS iname, any_value(ip) AS ip, any_value(away) AS away,
  arg_min(rk - 1, -verification * 1000 + rk) FILTER (flips) AS flip FROM d GROUP BY l_orderkey)
SELECT l_orderkey, round(margin, 6) AS margin, CASE WHEN ip >= 2 AND tv > 0 AND tv > iv + 0.05 AND away < 100 THEN 1 ELSE 0 END AS refines,
  CASE WHEN tss >= 0.8 AND (margin IS NULL OR margin >= 0.25) AND away >= 100 AND iv < 0.1 AND tv > iv AND tn >= iname THEN 1 ELSE 0 END AS challenges, flip::INT AS flip FROM m""",
    "local_scales": """WITH p AS (SELECT c_custkey AS page, c_custkey * 53 % 1000 / 10.0::DOUBLE AS lon, c_custkey * 17 % 997 / 10.0::DOUBLE AS lat, pow(2.0, c_custkey % 3) * (1 + c_custkey % 7 / 100.0::DOUBLE) AS scale FROM customer),
n AS (SELECT a.page, any_value(a.scale) AS scale, count(b.page) AS n, median(b.scale) AS median FROM p a LEFT JOIN p b ON a.page <> b.page AND abs(a.lon - b.lon) <= 3 AND abs(a.lat - b.lat) <= 3 GROUP BY a.page),
r AS (SELECT *, log2(median / 2) AS f, greatest(-1, least(1, round_even(log2(median / 2), 0))) AS k FROM n)
SELECT page, n, round(median, 6) AS median, CASE WHEN n >= 2 AND abs(f - k) <= log2(1.15) THEN pow(2.0, k) ELSE 1.0 END AS rung, CASE WHEN n >= 2 AND scale / median BETWEEN 0.75 AND 1.25 THEN 1 ELSE 0 END AS corroborated FROM r""",
    "placement_outcome": f"""WITH {_PAGES}, v AS (SELECT volume, q * 5 AS before, l_partkey % 260 AS after, l_linenumber / 8 AS land FROM p),
d AS (SELECT volume, land, CASE WHEN after <= 25 THEN 1 WHEN after >= 200 THEN -1 ELSE 0 END - CASE WHEN before <= 25 THEN 1 WHEN before >= 200 THEN -1 ELSE 0 END AS change FROM v)
SELECT volume, round(sum(change * land), 6) AS delta, count(*) FILTER (change > 0) AS better, count(*) FILTER (change < 0) AS worse FROM d GROUP BY volume""",
}
