"""Work on equal things once: rows of equal content as one class, and pairs of classes as pairs of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.session import kept

#: Members of a class in one row where pairs are made, so that a task takes a share of a large class.
MEMBERS = 1024


def classes(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, content, members): rows of equal content as one, under their least key, with all their keys."""
    found = df.where(F.col(key).isNotNull()).groupBy(content).agg(F.min(key).alias(key), F.collect_list(key).alias("members"))
    return kept(found.select(key, content, "members"), "copies")


def _parts(members: str) -> Column:
    """Members in rows of MEMBERS at most."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(members) - 1) / MEMBERS).cast("int")), lambda i: F.slice(members, i * MEMBERS + 1, F.lit(MEMBERS))))


def member_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, first: str, second: str) -> DataFrame:
    """pairs (first, second, ...) of classes as pairs of their members; left (first, members), right (second, members)."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in pairs.columns if c not in (first, second)]
    both = pairs.join(left.select(first, F.col("members").alias("m1")), first).join(right.select(second, F.col("members").alias("m2")), second)
    both = both.select(*rest, _parts("m1").alias("m1"), "m2").select(*rest, "m1", _parts("m2").alias("m2")).repartition(n)
    return both.select(*rest, F.explode("m1").alias(first), "m2").select(*rest, first, F.explode("m2").alias(second)).select(first, second, *rest)
