"""The evaluation query: weighted net placement score by volume, then the mean of volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import table


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per panel: sheet = order, panel = lineitem, volume = customer nation.

    A sheet without panels is one unplaced row of weight 1. A panel's weight is its share of its
    sheet (extended price) times its land fraction (1 - discount).
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    totals = lines.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.count("*").alias("n"))
    shares = lines.join(totals, "l_orderkey").select(
        "l_orderkey",
        (F.col("l_quantity") * F.col("l_quantity") / 10).alias("rmse"),
        (F.when(F.col("total") > 0, F.col("l_extendedprice") / F.col("total")).otherwise(1 / F.col("n")) * (1 - F.col("l_discount"))).alias("weight"),
    )
    return (
        orders.join(shares, orders.o_orderkey == shares.l_orderkey, "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("volume"), "o_orderkey", "rmse", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    )


def volume_scores(rows: DataFrame) -> DataFrame:
    """Bands: good <= 25 ft, fair <= 50, poor < 200, disaster >= 200; unplaced rows stay in the denominator."""
    share = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return rows.groupBy("volume").agg(
        F.count("*").alias("n_panels"),
        F.count("rmse").alias("n_placed"),
        F.round(share(F.col("rmse") <= 25), 6).alias("good"),
        F.round(share((F.col("rmse") > 25) & (F.col("rmse") <= 50)), 6).alias("fair"),
        F.round(share((F.col("rmse") > 50) & (F.col("rmse") < 200)), 6).alias("poor"),
        F.round(share(F.col("rmse") >= 200), 6).alias("disaster"),
        F.round(share(F.col("rmse") <= 25) - share(F.col("rmse") >= 200), 6).alias("net"),
    )


def weighted_net_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume_scores(panels(spark, sf_dir))


def mean_of_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain mean over volumes, not pooled over panels."""
    return volume_scores(panels(spark, sf_dir)).agg(
        F.count("*").alias("n_volumes"), *[F.round(F.avg(c), 5).alias(f"mean_{c}") for c in ("good", "disaster", "net")]
    )


_PANELS = """WITH totals AS (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY 1),
shares AS (SELECT l.l_orderkey, l.l_quantity * l.l_quantity / 10 AS rmse,
  (CASE WHEN total > 0 THEN l.l_extendedprice / total ELSE 1.0 / n END) * (1 - l.l_discount) AS weight
  FROM lineitem l JOIN totals USING (l_orderkey)),
panels AS (SELECT c_nationkey AS volume, rmse, coalesce(weight, 1.0)::DOUBLE AS weight
  FROM orders LEFT JOIN shares ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
volumes AS (SELECT volume, count(*) AS n_panels, count(rmse) AS n_placed,
  round(sum(CASE WHEN rmse <= 25 THEN weight ELSE 0 END) / sum(weight), 6) AS good,
  round(sum(CASE WHEN rmse > 25 AND rmse <= 50 THEN weight ELSE 0 END) / sum(weight), 6) AS fair,
  round(sum(CASE WHEN rmse > 50 AND rmse < 200 THEN weight ELSE 0 END) / sum(weight), 6) AS poor,
  round(sum(CASE WHEN rmse >= 200 THEN weight ELSE 0 END) / sum(weight), 6) AS disaster,
  round(sum(CASE WHEN rmse <= 25 THEN weight ELSE 0 END) / sum(weight) - sum(CASE WHEN rmse >= 200 THEN weight ELSE 0 END) / sum(weight), 6) AS net
  FROM panels GROUP BY volume)
"""

QUERIES = {"weighted_net_score": weighted_net_score, "mean_of_volumes": mean_of_volumes}
ORACLES = {
    "weighted_net_score": _PANELS + "SELECT * FROM volumes",
    "mean_of_volumes": _PANELS + "SELECT count(*) AS n_volumes, round(avg(good), 5) AS mean_good, round(avg(disaster), 5) AS mean_disaster, round(avg(net), 5) AS mean_net FROM volumes",
}
