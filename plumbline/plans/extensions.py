"""Approximate aggregates, and functions of one's own in SQL: an aggregate and a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.session import table


def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate counts and percentiles of each supplier's lines lie within their stated errors of the exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    made = lines.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("d"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("p"), F.percentile("l_extendedprice", 0.49).alias("lo"), F.percentile("l_extendedprice", 0.51).alias("hi"),
    )
    near = (F.abs(F.col("a") - F.col("d")) <= 0.1 * F.col("d") + 1).cast("int")
    return made.select("l_suppkey", "n", near.alias("near_distinct"), F.col("p").between(F.col("lo"), F.col("hi")).cast("int").alias("near_median"))


@F.pandas_udf(T.DoubleType())
def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
    """Aggregate: the mean by weights; null without any."""
    total = weight.sum()
    return float((value * weight).sum() / total) if total else None


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of one's own, called from SQL."""
    spark.udf.register("weighted_mean", weighted_mean)
    lines = table(spark, sf_dir, "lineitem")
    found = spark.sql("SELECT l_suppkey, weighted_mean(CAST(l_quantity AS DOUBLE), CAST(l_linenumber AS DOUBLE)) AS mean FROM {lines} GROUP BY l_suppkey", lines=lines)
    return found.select("l_suppkey", F.round("mean", 6).alias("mean"))


@F.udtf(returnType=T.StructType([T.StructField("page", T.LongType()), T.StructField("piece", T.IntegerType())]))
class PagePieces:
    """A row for each piece of a page spec of plain numbers."""

    def eval(self, spec: str):
        for i, part in enumerate((spec or "").split(",")):
            first, _, last = part.partition("-")
            if first.strip().isdigit():
                for page in range(int(first), int(last or first) + 1):
                    yield page, i


def spec_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of one's own, called from SQL beside each row."""
    spark.udtf.register("page_pieces", PagePieces)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%d-%d,%d", F.col("p_size"), F.col("p_size") + 2, F.col("p_size") + 9).alias("spec"))
    found = spark.sql("SELECT p_partkey, page, piece FROM {parts}, LATERAL page_pieces(spec)", parts=parts)
    return found.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum("page").alias("pages"), F.max("piece").alias("pieces"))


QUERIES = {f.__name__: f for f in (approximate_counts, weighted_means, spec_pieces)}
ORACLES = {
    "approximate_counts": "SELECT l_suppkey, count(*) AS n, 1 AS near_distinct, 1 AS near_median FROM lineitem GROUP BY l_suppkey",
    "weighted_means": "SELECT l_suppkey, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS mean FROM lineitem GROUP BY l_suppkey",
    "spec_pieces": "SELECT p_partkey, 4::BIGINT AS n, (4 * p_size + 12)::BIGINT AS pages, 1 AS pieces FROM part",
}
