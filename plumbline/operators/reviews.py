"""Views of labels and candidates for review: filters as a viewer shows them, like poses merged, and summaries of joins and panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import geo, keys
from plumbline.operators import faces
from plumbline.operators.fits import assignment
from plumbline.operators.greedy import by_page, degrees_apart, edges, first_of_each
from plumbline.session import table

#: Metres and degrees within which candidates are one, feet within which hypotheses are, and their nominal sheet; points that a join's strip needs, and the clamp of its distances.
ONE_LOCK_M, ONE_LOCK_DEG, SAME_POSE_FT, NOMINAL = 60.0, 10.0, 10.0, 1000.0
STRIP_POINTS, STRIP_CLAMP_M = 500, 30.0


def shown_labels(labels: DataFrame, query: str = "", *, least: float, min_short: float, min_long: float, aspect: float, share: float | None = None, ignored: bool = False) -> DataFrame:
    """labels (text, confidence, short_side, long_side, ignore, ...) that a viewer's filters let through; relaxed marks those that only their confidence lets through (share: the size that full confidence needs)."""
    c = F.col
    plain = (c("confidence") >= least) & keys.matches_query(c("text"), query) & (c("long_side") >= aspect * c("short_side"))
    plain = plain if ignored else plain & ~F.coalesce("ignore", F.lit(False))
    strict = (c("short_side") >= min_short) & (c("long_side") >= min_long)
    if share is None:
        return labels.where(plain & strict).withColumn("relaxed", F.lit(False))
    need = geo.relaxed_threshold(c("confidence"), F.lit(least), F.lit(min_short), F.lit(min_short * share))
    part = need / min_short if min_short > 0 else F.lit(1.0)
    return labels.where(plain & (strict | ((c("short_side") >= need) & (c("long_side") >= min_long * part)))).withColumn("relaxed", ~strict)


def shown_boxes(boxes: DataFrame, min_short: float, min_long: float) -> DataFrame:
    return boxes.where((F.col("short_side") >= min_short) & (F.col("long_side") >= min_long))


def merged_candidates(candidates: DataFrame, top: int) -> DataFrame:
    """candidates (page, option, score, lon, lat, theta) by score, without those that are at one place and turn with a better one; top of a page at most, ranked from 0."""

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        lon, lat, theta, out = *(rows[c].to_numpy(float) for c in ("lon", "lat", "theta")), []

        def same(i: int, k: int) -> bool:
            half = lambda a, b: np.sin(np.radians(b - a) / 2) ** 2
            h = half(lat[i], lat[k]) + np.cos(np.radians(lat[i])) * np.cos(np.radians(lat[k])) * half(lon[i], lon[k])
            return 2 * geo.RADIUS_FT / geo.FEET * np.arcsin(np.sqrt(min(h, 1.0))) < ONE_LOCK_M and degrees_apart(theta[i], theta[k]) < ONE_LOCK_DEG

        for i, j in edges(rows["page"]):
            out += [(i + k, rank) for rank, k in enumerate(first_of_each(list(range(i, j)), same, top))]
        return rows.iloc[[k for k, _ in out]].assign(rank=[r for _, r in out])

    used = candidates.select("page", F.col("option").cast("long"), *[F.col(c).cast("double") for c in ("score", "lon", "lat", "theta")]).where("score IS NOT NULL")
    return by_page(used, "page", [F.desc("score"), "option"], made, "page long, option long, score double, lon double, lat double, theta double, rank long")


def merged_hypotheses(poses: DataFrame) -> DataFrame:
    """(page, option, points, sources): poses (page, option, affine, points, source) with later ones that are the same pose taken into the first, and the most control points of any."""
    corner = lambda m, x, y: F.array(*geo.apply_affine(m, F.lit(x), F.lit(y)))
    at = F.array(*[corner(F.col("affine"), x, y) for x in (0.125 * NOMINAL, 0.5 * NOMINAL, 0.875 * NOMINAL) for y in (0.125 * NOMINAL, 0.5 * NOMINAL, 0.875 * NOMINAL)])
    used = poses.where("affine IS NOT NULL").select("page", F.col("option").cast("long").alias("option"), at.alias("places"), F.col("points").cast("long").alias("points"), "source")

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, j in edges(rows["page"]):
            places = [np.array([list(p) for p in x]) for x in rows["places"].iloc[i:j]]

            def same(a: int, b: int, places=places) -> bool:
                d = (places[a] - places[b]) * [geo.LON_M * np.cos(np.radians(places[b][:, 1].mean())), geo.LAT_M]
                return float(np.sqrt((d * d).sum(axis=1).mean())) * geo.FEET < SAME_POSE_FT

            kept = first_of_each(list(range(j - i)), same)
            home = [next(k for k in kept if k <= n and (k == n or same(n, k))) for n in range(j - i)]
            for k in kept:
                mine = [i + n for n, h in enumerate(home) if h == k]
                out.append((rows["page"].iloc[i], rows["option"].iloc[i + k], int(rows["points"].iloc[mine].max()), rows["source"].iloc[mine].tolist()))
        return pd.DataFrame(out, columns=["page", "option", "points", "sources"])

    return by_page(used, "page", ["option"], made, "page long, option long, points long, sources array<string>")


def join_score(refined: Column, plausible: Column, points: Column, inliers: Column, correlation: Column, chamfer_m: Column) -> Column:
    """How well two sheets' edges join: their inliers and correlation less the clamped distance; the least where there is too little to go by."""
    score = inliers + correlation - chamfer_m / STRIP_CLAMP_M
    return F.when(refined & plausible & (points >= STRIP_POINTS), score).otherwise(float("-inf"))


def join_summary(joins: DataFrame) -> DataFrame:
    """One row of attempts at joins (status, rmse_ft, best_ft, inliers): percentiles, shares within some feet, what ranking lost and wrong locks."""
    ok = (F.col("status") == "ok") & F.col("rmse_ft").isNotNull()
    value = F.when(ok, F.col("rmse_ft"))
    shares = [F.avg(F.when(ok, (F.col("rmse_ft") <= t).cast("double"))).alias(f"within_{t}") for t in (15, 25, 50, 100)]
    return joins.agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("scored"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("worst"), *shares,
        (F.count_if(ok & (F.col("best_ft") <= 25)) - F.count_if(ok & (F.col("rmse_ft") <= 25))).alias("ranking_losses"), F.count_if(ok & (F.col("rmse_ft") > 100) & (F.col("inliers") > 0.6)).alias("wrong_locks"),
    )


def matched_iou(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(page, n, m, iou): mean overlap of panels of truth and found (page, panel, ring), matched so that its sum is greatest; those without a partner count 0."""
    side = lambda df: df.select(F.struct("page", "panel").alias("key"), "page", "panel", "ring")
    met = side(truth).join(side(found).select("page", F.col("panel").alias("other"), F.col("ring").alias("ring2")), "page")  # few panels on a page
    pairs = met.select("page", "panel", "other", faces.shared("ring", "ring2")["iou"].alias("iou"))
    sizes = truth.groupBy("page").agg(F.count("*").alias("n")).join(found.groupBy("page").agg(F.count("*").alias("m")), "page", "full").na.fill(0)

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, j in edges(rows["page"]):
            grid = rows.iloc[i:j].pivot_table(index="panel", columns="other", values="iou", fill_value=0.0).to_numpy()
            grid = grid if grid.shape[0] <= grid.shape[1] else grid.T
            out.append((rows["page"].iloc[i], float(grid[np.arange(len(grid)), assignment(-grid)].sum())))
        return pd.DataFrame(out, columns=["page", "total"])

    best = by_page(pairs, "page", ["panel", "other"], made, "page long, total double")
    return sizes.join(best, "page", "left").select("page", "n", "m", (F.coalesce("total", F.lit(0.0)) / F.greatest("n", "m")).alias("iou"))


def panel_counts(panels: DataFrame) -> DataFrame:
    """(key, n): panels of each cut page (page, panel)."""
    return panels.groupBy(keys.page_key(F.col("page")).alias("key")).agg(F.count("*").alias("n")).where("key IS NOT NULL")


def with_land(rows: DataFrame, land: DataFrame) -> DataFrame:
    """rows (page, area, ...) with the land of each page (page, land), all of it where none is known, and its area of land."""
    both = rows.join(land.select("page", "land"), "page", "left").withColumn("land", F.coalesce("land", F.lit(1.0)))
    return both.withColumn("land_area", F.col("area") * F.col("land"))


def label_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as labels under a viewer's filters, strict and relaxed, by supplier."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(c("l_partkey") % 2 == 0, "Main St").otherwise("Elm").alias("text"), (c("l_discount") * 10).alias("confidence"), (c("l_linenumber") * 3.0).alias("short_side"), (c("l_quantity") * 2).alias("long_side"), (c("l_partkey") % 13 == 0).alias("ignore"))
    found = shown_labels(rows, "st, oak", least=0.2, min_short=12.0, min_long=30.0, aspect=1.5, share=0.5)
    return found.groupBy("l_suppkey").agg(F.count("*").alias("shown"), F.count_if("relaxed").alias("relaxed"))


def join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(F.when(c("l_returnflag") == "N", "ok").otherwise("failed").alias("status"), (c("l_quantity") * 4).alias("rmse_ft"), (c("l_linenumber") * 8).alias("best_ft"), (c("l_discount") * 10).alias("inliers"))
    found = join_summary(rows)
    return found.select("attempts", "scored", "median", F.round("p90", 6).alias("p90"), "worst", *[F.round(k, 6).alias(k) for k in found.columns if k.startswith("within")], "ranking_losses", "wrong_locks")


QUERIES = {"label_view": label_view, "join_report": join_report}
ORACLES = {
    "label_view": """WITH l AS (SELECT l_suppkey, l_discount * 10 AS conf, l_linenumber * 3.0 AS s, l_quantity * 2 AS w FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey % 13 <> 0),
n AS (SELECT *, s >= 12 AND w >= 30 AS strict, CASE WHEN conf <= 0.2 THEN 12.0 ELSE 12.0 * pow(0.2 / least(conf, 1.0), ln(0.5) / ln(0.2)) END AS need FROM l WHERE conf >= 0.2 AND w >= 1.5 * s)
SELECT l_suppkey, count(*) AS shown, count(*) FILTER (NOT strict) AS relaxed FROM n WHERE strict OR (s >= need AND w >= 30 * (need / 12)) GROUP BY l_suppkey""",
    "join_report": """WITH r AS (SELECT l_returnflag = 'N' AS ok, l_quantity * 4 AS r, l_linenumber * 8 AS b, l_discount * 10 AS i FROM lineitem)
SELECT count(*) AS attempts, count(*) FILTER (ok) AS scored, median(r) FILTER (ok) AS median, round(quantile_cont(r, 0.9) FILTER (ok), 6) AS p90, max(r) FILTER (ok) AS worst, round(avg((r <= 15)::INT) FILTER (ok), 6) AS within_15, round(avg((r <= 25)::INT) FILTER (ok), 6) AS within_25,
  round(avg((r <= 50)::INT) FILTER (ok), 6) AS within_50, round(avg((r <= 100)::INT) FILTER (ok), 6) AS within_100, count(*) FILTER (ok AND b <= 25) - count(*) FILTER (ok AND r <= 25) AS ranking_losses, count(*) FILTER (ok AND r > 100 AND i > 0.6) AS wrong_locks FROM r""",
}
