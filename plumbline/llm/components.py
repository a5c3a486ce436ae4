"""Connected components of an edge list, by contraction.

Each round hooks every node to its least neighbour, jumps pointers, and renames the edges, so the
graph shrinks geometrically. Before the first round each partition replaces its own edges by a
spanning forest, so a hub with a third of all edges leaves at most one edge per node and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.store import written


class Forest:
    """Union-find over arbitrary integer ids; the root of a set is its least id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = up.setdefault(x, x)
        while top != up[top]:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(a, c)
    pairs = np.array(forest.edges(), dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b: long, no nulls): component is the least node reachable.

    Self-loops and repeated edges are harmless; an empty edge list gives an empty table.
    """
    left = written(edges.select("a", "b").where("a <> b").mapInArrow(_thinned, "a long, b long"), "cc-edges")
    names = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.union(left.select("b", "a"))
        hooked = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up"))
        hooked = written(hooked, "cc-hook")
        while True:  # pointer jumping until each node points at a root: a chain halves each time
            upper = hooked.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            jumped = hooked.join(upper, hooked.up == upper.n2).select("node", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved"))
            jumped = written(jumped, "cc-jump")
            hooked = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        names = hooked if names is None else written(
            names.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up", "left")
            .select("node", F.coalesce("up2", "up").alias("up")),
            "cc-names",
        )
        one = left.join(hooked.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        two = one.join(hooked.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = written(two.select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b").distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not converge")
    if names is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names.select("node", F.col("up").alias("component"))
