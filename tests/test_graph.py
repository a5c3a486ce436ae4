"""Graph operators and fits against brute force."""

import itertools
import random

import numpy as np

from plumbline.operators import fits, graph


def test_components_and_hops_equal_a_walk(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(starts):
        found, front = dict.fromkeys(starts, 0), list(starts)
        while front:
            front = [y for x in front for y in near.get(x, ()) if y not in found and not found.update({y: found[x] + 1})]
        return found

    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {n: min(walk([n])) for n in near}
    reach = {r["node"]: r["hop"] for r in graph.hops(edges.dropna(), spark.createDataFrame([(100,), (110,)], "node long"), 5).collect()}
    assert reach == {n: h for n, h in walk([100, 110]).items() if h <= 5}
    assert graph.components(edges.limit(0)).count() == 0


def test_joint_choice_is_the_least(spark):
    rng = random.Random(5)
    unary = {n: [round(rng.random(), 3) for _ in range(3)] for n in range(6)}
    energy = {(a, i, a + 1, j): round(rng.random(), 3) for a in (0, 1, 3) for i in range(3) for j in range(3)}
    options = spark.createDataFrame([(n, i, u, i == 1) for n, us in unary.items() for i, u in enumerate(us)], "node long, option int, unary double, published boolean")
    pairs = spark.createDataFrame([(*k, e) for k, e in energy.items()], "a long, oa int, b long, ob int, energy double")
    got = {r["node"]: r["option"] for r in graph.joint_choice(options, pairs).collect()}
    links = sorted({(a, b) for a, _, b, _ in energy})
    least = min(graph._total(dict(enumerate(c)), unary, energy, links) for c in itertools.product(range(3), repeat=6))
    assert abs(graph._total(got, unary, energy, links) - least) < 1e-9


def claimed(spark, folder, keys):
    """What claim_choice takes for suppliers of these keys: its total energy, that of another choice, and the choice."""
    rng = random.Random(len(keys))
    lines = [(k, o, 1, 1, 300.0 - o, rng.randrange(1, 11) / 50, rng.randrange(1, 8)) for k in keys for o in range(3)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double, l_quantity long").write.parquet(f"{folder}/lineitem.parquet")
    at = {(k, o): (q / 50, d) for k, o, _, _, _, d, q in lines}
    energy = lambda c: sum(at[x][0] for x in c.items()) + sum(abs(at[k, c[k]][1] - at[k + 1, c[k + 1]][1]) for k in c if k + 1 in c)
    return {r["node"]: r["option"] for r in graph.claim_choice(spark, str(folder)).collect()}, energy


def test_claims_are_chosen_across_multiples_of_five(spark, tmp_path):
    got, energy = claimed(spark, tmp_path, range(2, 9))
    assert abs(energy(got) - min(energy(dict(zip(got, c, strict=True))) for c in itertools.product(range(3), repeat=7))) < 1e-9


def test_long_runs_of_claims_are_swept(spark, tmp_path):
    got, energy = claimed(spark, tmp_path, range(3, 43))
    assert len(got) == 40 and 3**40 > graph.EXHAUSTIVE
    assert all(energy(got) <= energy({**got, k: o}) + 1e-9 for k in got for o in range(3))


def test_sweeps_reach_a_stable_choice(monkeypatch):
    unary, energy = {n: [0.3, 0.2] for n in range(5)}, {(n, i, n + 1, j): float(i != j) for n in range(4) for i in range(2) for j in range(2)}
    monkeypatch.setattr(graph, "EXHAUSTIVE", 1)
    assert graph.best_choice(unary, dict.fromkeys(unary, 0), energy) == dict.fromkeys(unary, 1)


def test_assignment_equals_permutations():
    rng = np.random.default_rng(6)
    for n, m in [(1, 1), (3, 3), (4, 6), (5, 5)] * 8:
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = fits.assignment(cost)
        assert len(set(got.tolist())) == n
        assert cost[np.arange(n), got].sum() == min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_spline_meets_its_points_and_keeps_affine_maps():
    rng = np.random.default_rng(7)
    a = rng.random((8, 2)) * 10
    bent = rng.random((8, 2))
    assert np.allclose(fits.spline(a, bent, 0.0)(a), bent, atol=1e-6)
    affine = a @ np.array([[2.0, 1.0], [-1.0, 3.0]]) + 4
    other = rng.random((5, 2)) * 10
    assert np.allclose(fits.spline(a, affine, 5.0)(other), other @ np.array([[2.0, 1.0], [-1.0, 3.0]]) + 4, atol=1e-6)


def test_queries_run(spark):
    rows = fits.slot_assignment(spark, "/root/testdata/sf0.001")
    assert rows.count() == rows.select("l_orderkey", "slot").distinct().count() == 6000
    assert fits.page_splines(spark, "/root/testdata/sf0.001").where("rmse IS NULL OR rmse < 0").count() == 0
    assert graph.claim_choice(spark, "/root/testdata/sf0.001").count() == 10
