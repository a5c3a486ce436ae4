"""Graph operators: connected components, hops from anchors, and the joint choice of one option a node.

Rounds are written to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.plans.linkage import _CLAIMS, query
from plumbline.session import kept, table

#: Combinations up to which a component is searched in full, and sweeps beyond that.
EXHAUSTIVE, SWEEPS = 20_000, 50


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of edges (a, b: long): the least node reachable. Labels spread by neighbours and by pointer jumping, so chains halve."""
    both = edges.select("a", "b").dropna()
    both = kept(both.union(both.select("b", "a")).distinct(), "graph-edges")
    labels = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "graph-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        spread = kept(labels.join(near, "node").select("node", "label", F.least("label", "other").alias("best")), "graph-spread")
        jump = spread.select(F.col("node").alias("best"), F.col("best").alias("far"))
        after = kept(spread.join(jump, "best").select("node", F.least("best", "far").alias("label"), (F.least("best", "far") < F.col("label")).alias("moved")), "graph-labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not converge")


def hops(edges: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(node, hop) of the nodes within limit edges of an anchor (node: long), by least hop; edges (a, b) go both ways."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "graph-edges")
    front = reached = kept(anchors.select("node").dropna().distinct().withColumn("hop", F.lit(0)), "graph-hops")
    for hop in range(1, limit + 1):
        met = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = kept(met.join(reached, "node", "left_anti").withColumn("hop", F.lit(hop)), "graph-hops")
        if front.isEmpty():
            break
        reached = reached.union(front)
    return reached


def _total(choice: dict, unary: dict, energy: dict, pairs: list) -> float:
    return sum(unary[n][o] for n, o in choice.items()) + sum(energy.get((a, choice[a], b, choice[b]), 0.0) for a, b in pairs)


def best_choice(unary: dict, start: dict, energy: dict) -> dict:
    """One option a node of the least energy; of equals the one with fewest changes from start, then the lowest options.

    unary: node to list of energies; energy: (a, option, b, option) to energy, 0 where absent. Searched
    in full up to EXHAUSTIVE combinations, else by sweeps from three starts: start, least unary, last options.
    """
    nodes, pairs = sorted(unary), sorted({(a, b) for a, _, b, _ in energy})
    combinations = 1
    for n in nodes:
        combinations *= len(unary[n])
    key = lambda c: (round(_total(c, unary, energy, pairs), 9), sum(c[n] != start[n] for n in nodes))
    if combinations <= EXHAUSTIVE:
        return min((dict(zip(nodes, x)) for x in product(*(range(len(unary[n])) for n in nodes))), key=lambda c: (*key(c), [c[n] for n in nodes]))
    near = {n: [] for n in nodes}
    for p in pairs:
        for n in set(p):
            near[n].append(p)
    found = []
    for begin in (start, {n: min(range(len(unary[n])), key=lambda i, n=n: (unary[n][i], i)) for n in nodes}, {n: len(unary[n]) - 1 for n in nodes}):
        choice = dict(begin)
        for _ in range(SWEEPS):
            before = dict(choice)
            for n in nodes:
                at = lambda i, n=n: _total({n: i}, unary, {}, []) + sum(energy.get((a, i if a == n else choice[a], b, i if b == n else choice[b]), 0.0) for a, b in near[n])
                choice[n] = min(range(len(unary[n])), key=lambda i, at=at: (round(at(i), 9), i))
            if choice == before:
                break
        found.append(choice)
    return min(found, key=key)


def joint_choice(options: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, option) of the least joint energy, component by component.

    options: (node long, option int from 0 without gaps, unary double, published boolean); pairs: (a, oa, b, ob, energy), a < b.
    A component is the pages of one volume that touch, so it fits a task; a node without a published option starts at its last.
    """
    names = components(pairs.select("a", "b"))
    held = options.join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = pairs.join(names.withColumnRenamed("node", "a"), "a")

    def made(o: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        o = o.sort_values(["node", "option"])
        unary = {n: g["unary"].tolist() for n, g in o.groupby("node")}
        start = {n: len(u) - 1 for n, u in unary.items()} | dict(o.loc[o["published"], ["node", "option"]].itertuples(index=False))
        energy = {(a, i, b, j): e for a, i, b, j, e in p[["a", "oa", "b", "ob", "energy"]].itertuples(index=False) if a in unary and b in unary}
        return pd.DataFrame(list(best_choice(unary, start, energy).items()), columns=["node", "option"])

    return held.groupBy("component").cogroup(linked.groupBy("component")).applyInPandas(made, "node long, option int")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("page")).distinct()


def page_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring page numbers as components: long chains, the hard case of label spreading."""
    pages = kept(_pages(spark, sf_dir), "graph-pages")
    return components(pages.select(F.col("page").alias("a"), (F.col("page") + 1).alias("b")).join(pages.withColumnRenamed("page", "b"), "b"))


def claim_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops(query(f"WITH {_CLAIMS} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM claims")(spark, sf_dir), spark.range(1).select(F.lit(0).cast("long").alias("node")), 4)


def claim_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier takes one of its three largest lines; two suppliers with following keys pay for unlike discounts, so that runs of keys are components."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber")
    top = table(spark, sf_dir, "lineitem").withColumn("option", F.row_number().over(order) - 1).where("option < 3")
    top = kept(top.select(F.col("l_suppkey").alias("node"), "option", F.col("l_discount").alias("d"), (F.col("l_quantity") / 50).alias("unary"), (F.col("option") == 0).alias("published")), "graph-options")
    near = top.select(F.col("node").alias("a"), F.col("option").alias("oa"), F.col("d").alias("da")).join(
        top.select((F.col("node") - 1).alias("a"), F.col("node").alias("b"), F.col("option").alias("ob"), F.col("d").alias("db")), "a"
    )
    return joint_choice(top.drop("d"), near.select("a", "oa", "b", "ob", F.abs(F.col("da") - F.col("db")).alias("energy")))


QUERIES = {"page_components": page_components, "claim_hops": claim_hops, "claim_choice": claim_choice}
ORACLES = {
    "page_components": """WITH p AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_quantity >= 49), g AS (SELECT node, node - row_number() OVER (ORDER BY node) AS island FROM p)
SELECT node, min(node) OVER (PARTITION BY island) AS component FROM g QUALIFY count(*) OVER (PARTITION BY island) > 1""",
    "claim_hops": f"""WITH RECURSIVE {_CLAIMS}, e AS (SELECT a, b FROM claims UNION SELECT b, a FROM claims),
r AS (SELECT 0 AS node, 0 AS hop UNION SELECT e.b, r.hop + 1 FROM r JOIN e ON e.a = r.node WHERE r.hop < 4) SELECT node::BIGINT AS node, min(hop) AS hop FROM r GROUP BY node""",
}
