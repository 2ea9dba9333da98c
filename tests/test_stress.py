"""Layouts by distances, and layouts by code, against numpy and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.operators import layout, stress
from netspark.session import cut

from .test_network import TREE, TRIANGLE, graph

RING = [(a, b) for a, b in zip("ABCDEF", "BCDEFA", strict=True)]
TAIL = [*TRIANGLE, ("C", "D"), ("D", "E"), ("E", "F"), ("B", "F"), ("F", "G")]


def places(df):
    return {r.node: (r.x, r.y) for r in df.collect()}


def test_scaling_of_a_path_recovers_its_distances(spark):
    at = places(stress.classical_scaling(graph(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")])))
    for a in at:
        for b in at:
            assert math.dist(at[a], at[b]) == pytest.approx(abs(ord(a) - ord(b)), abs=1e-6)
    assert all(abs(y) < 1e-6 for _, y in at.values())


@pytest.mark.parametrize("edges", [TAIL, RING, [("A", "B"), ("B", "C"), ("X", "Y")]])
def test_scaling_like_numpy(spark, edges):
    net = graph(spark, edges)
    d = {(r.pivot, r.node): r.d for r in stress.pivot_distances(net).collect()}
    names = sorted({a for a, _ in d})
    table = np.array([[d[a, b] for b in names] for a in names])
    assert (table == table.T).all() and (np.diag(table) == 0).all()
    j = np.eye(len(names)) - 1 / len(names)
    values, vectors = np.linalg.eigh(-0.5 * j @ table**2 @ j)
    best = vectors[:, -2:] * np.sqrt(np.maximum(values[-2:], 0))
    at = places(stress.classical_scaling(net))
    got = np.array([at[a] for a in names])
    # Equal up to a turn or a mirror image: the products of places are the same.
    assert got @ got.T == pytest.approx(best @ best.T, abs=1e-6)
    if edges[-1] == ("X", "Y"):
        assert d["A", "X"] == 3.0


def test_scaling_by_fewer_pivots(spark):
    """A path is a line for any pivots; distances in the plane are those of the network times one factor."""
    path = [(f"{i:02d}", f"{i + 1:02d}") for i in range(30)]
    at = places(stress.classical_scaling(graph(spark, path), pivots=8))
    order = [at[k][0] for k in sorted(at)]
    assert order == sorted(order) or order == sorted(order, reverse=True)
    assert np.corrcoef(order, range(31))[0, 1] ** 2 > 0.98 and 20 < abs(order[0] - order[-1]) < 45


def test_stress_falls_each_step(spark):
    net = graph(spark, TAIL)
    d, at = stress.pivot_distances(net), layout.layout_random(net.nodes)
    table, now = {(r.pivot, r.node): r.d for r in d.collect()}, places(at)
    before = math.inf
    for _ in range(4):
        value = stress.stress(at, d).first().stress
        plain = sum((math.dist(now[a], now[b]) / g - 1) ** 2 for (a, b), g in table.items() if a != b)
        assert value == pytest.approx(plain) and value < before
        before, step = value, {}
        for a in now:
            asked = [(b, 1 / table[a, b] ** 2) for b in now if a != b]
            unit = {b: [(now[a][c] - now[b][c]) / math.dist(now[a], now[b]) for c in (0, 1)] for b, _ in asked}
            mean = [sum(w * (now[b][c] + table[a, b] * unit[b][c]) for b, w in asked) / sum(w for _, w in asked) for c in (0, 1)]
            step[a] = tuple((now[a][c] + mean[c]) / 2 for c in (0, 1))
        gathered = places(stress.gathered_step(at, stress._both_ways(d)))
        at, now = cut(stress.stress_step(at, d)), step
        assert {k: pytest.approx(v) for k, v in now.items()} == gathered
        assert {k: pytest.approx(v) for k, v in now.items()} == places(at)


def test_kamada_kawai(spark):
    at = places(stress.layout_kamada_kawai(graph(spark, RING), tolerance=1e-6))
    sides = [math.dist(at[a], at[b]) for a, b in RING]
    assert max(sides) - min(sides) < 0.05  # a regular hexagon
    net = graph(spark, [("A", "B"), ("B", "C")])
    long = net.with_edges(net.edges.withColumn("weight", F.when(F.col("src") == "A", 5.0).otherwise(1.0)))
    at = places(stress.layout_kamada_kawai(long))
    assert math.dist(at["A"], at["B"]) == pytest.approx(5, abs=0.05) and math.dist(at["B"], at["C"]) == pytest.approx(1, abs=0.05)
    with pytest.raises(ValueError):
        stress.layout_kamada_kawai(net.with_edges(net.edges.withColumn("weight", F.lit(-1.0))))


def test_trees_and_codes(spark):
    at = places(layout.layout_tree(graph(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("B", "E"), ("X", "Y")])))
    assert sorted(at[leaf][0] for leaf in "CDEY") == [1.0, 2.0, 3.0, 4.0] and abs(at["D"][0] - at["E"][0]) == 1.0
    assert at["B"] == ((at["D"][0] + at["E"][0]) / 2, -1.0) and at["A"] == (2.0, 0.0) and at["X"] == (at["Y"][0], 0.0) == (4.0, 0.0)
    assert [at[n][1] for n in "ABCDEXY"] == [0.0, -1.0, -1.0, -2.0, -2.0, 0.0, -1.0]
    ball = layout.layout_sphere(graph(spark, RING).nodes).collect()
    assert all(r.x**2 + r.y**2 + r.z**2 == pytest.approx(1) for r in ball) and {round(r.z, 6) for r in ball} == {-1.0, -0.6, -0.2, 0.2, 0.6, 1.0}
    for code in ("mds", "tr", "sp", "gr", "ci"):
        found = places(layout.by_code(graph(spark, TREE), code))
        assert len(found) == 5 and all(0.1 - 1e-9 <= c <= 0.9 + 1e-9 for xy in found.values() for c in xy)
    one = graph(spark, TREE).with_nodes(spark.createDataFrame([("A",)], "node string"))
    assert places(layout.by_code(one, "kk")) == places(layout.by_code(one, "mds")) == {"A": (0.5, 0.5)}
    with pytest.raises(ValueError):
        layout.by_code(one, "zz")


def test_hops_are_counted_for_all_pivots_together(spark, monkeypatch):
    """Hops from more pivots than a word has bits, without a table of pairs that grows in each pass."""

    def pairs(*_, **__):
        raise AssertionError("a pass held a row for each pair")

    monkeypatch.setattr(stress, "distances", pairs)
    tips = [(f"T{i:02}", f"T{(i + 1) % 9:02}") for i in range(9)]
    net = graph(spark, [*((f"H{i % 3}", f"L{i:02}") for i in range(60)), ("H0", "H1"), ("H1", "H2"), *tips])
    around = {}
    for r in net.around().collect():
        around.setdefault(r.node, set()).add(r.other)
    want = {}
    for a in around:
        at, front, hops = {a: 0.0}, {a}, 0.0
        while front:
            hops += 1
            front = {c for b in front for c in around[b]} - at.keys()
            at |= dict.fromkeys(front, hops)
        want |= {(a, b): at.get(b, 6.0) for b in around}  # once and a half the largest, 4
    got = {(r.pivot, r.node): r.d for r in stress.pivot_distances(net, pivots=66).collect()}
    assert len({p for p, _ in got}) == 66 and len(got) == 66 * 72
    assert got == {k: want[k] for k in got}
