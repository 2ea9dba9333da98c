"""Layouts by forces against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netspark.network import Network
from netspark.operators import forces


def network(spark, edges, nodes):
    return Network(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string, weight double"), False)


def plain_push(at, strength, least):
    out = {}
    for a, (x, y) in at.items():
        fx = fy = 0.0
        for b, (u, v) in at.items():
            if a != b:
                d = max(math.hypot(x - u, y - v), least)
                fx, fy = fx + (x - u) * strength / d / d, fy + (y - v) * strength / d / d
        out[a] = fx, fy
    return out


def plain_spring(edges, at, steps, cooling=0.95, repulsion=1.0, attraction=1.0, anchor=0.0):
    k, heat, start = 1 / math.sqrt(len(at)), 0.1, dict(at)
    for _ in range(steps):
        force = {a: list(f) for a, f in plain_push(at, repulsion * k * k, 0.001).items()}
        for a, b, w in edges:
            dx, dy = at[a][0] - at[b][0], at[a][1] - at[b][1]
            d = max(math.hypot(dx, dy), 0.001)
            for node, sign in ((a, -1), (b, 1)):
                force[node][0] += sign * dx * attraction * d / k * abs(w)
                force[node][1] += sign * dy * attraction * d / k * abs(w)
        new = {}
        for a, (x, y) in at.items():
            fx, fy = (force[a][i] + (start[a][i] - at[a][i]) * anchor for i in (0, 1))
            f = math.hypot(fx, fy)
            s = min(f, heat) / f if f else 0.0
            new[a] = tuple(min(max(c, 0.05), 0.95) for c in (x + fx * s, y + fy * s))
        at, heat = new, heat * cooling
    return at


def places(df):
    return {r.node: (r.x, r.y) for r in df.collect()}


def a_graph(seed=1):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    return nodes, [(*rng.sample(nodes, 2), rng.choice([1.0, -2.0, 0.5])) for _ in range(12)], {n: (rng.random(), rng.random()) for n in nodes}


def near(got, want, tolerance):
    assert got.keys() == want.keys()
    for n in want:
        assert got[n] == pytest.approx(want[n], abs=tolerance), n


def test_spring_equals_a_plain_loop(spark):
    nodes, edges, start = a_graph()
    net, initial = network(spark, edges, nodes), spark.createDataFrame([(n, *p) for n, p in start.items()], "node string, x double, y double")
    options = {"repulsion": 0.5, "attraction": 2.0}
    near(places(forces.layout_spring(net, 10, initial=initial, anchor_strength=0.3, **options)), plain_spring(edges, start, 10, anchor=0.3, **options), 1e-6)
    held = places(forces.layout_spring(net, 10, initial=initial, max_displacement=0.05))
    free = plain_spring(edges, start, 10)
    for n, (x, y) in held.items():
        far = math.dist(free[n], start[n])
        assert math.dist((x, y), start[n]) == pytest.approx(min(far, 0.05), abs=1e-6)
    # left out steps move nothing
    near(places(forces.layout_spring(net, 500, cooling=0.3, initial=initial)), plain_spring(edges, start, 40, cooling=0.3), 1e-5)
    near(places(forces.layout_spring(network(spark, [], nodes), initial=initial)) if False else places(forces.layout_spring(net, 0, initial=initial)), start, 0)


def test_gephi_equals_a_plain_loop(spark):
    nodes, edges, start = a_graph(2)
    at = {n: (1000 * x - 500, 1000 * y - 500) for n, (x, y) in start.items()}
    initial = spark.createDataFrame([(n, *p) for n, p in at.items()], "node string, x double, y double")
    got = places(forces.layout_gephi_fr(network(spark, edges, nodes), niter=6, initial=initial))
    k, pace = math.sqrt(1e8 / 10), 1 / 800
    for _ in range(6):
        force = {a: list(f) for a, f in plain_push(at, k * k, 1e-12).items()}
        for a, b, _ in edges:
            dx, dy = at[a][0] - at[b][0], at[a][1] - at[b][1]
            d = math.hypot(dx, dy)
            for node, sign in ((a, -1), (b, 1)):
                force[node][0] += sign * dx * d / k
                force[node][1] += sign * dy * d / k
        new = {}
        for a, (x, y) in at.items():
            fx, fy = (force[a][0] - x * 0.1 * k) * pace, (force[a][1] - y * 0.1 * k) * pace
            f = math.hypot(fx, fy)
            s = min(1.0, 1000 * pace / f) if f else 1.0
            new[a] = x + fx * s, y + fy * s
        at = new
    near(got, at, 1e-4)


def test_cells_meet_every_pair_once(spark):
    """The number of nodes met is exact; the pushes nearly are."""
    rng = random.Random(4)
    at = {f"n{i}": (rng.random() ** 2, rng.random()) for i in range(300)}
    table = spark.createDataFrame([(n, *p) for n, p in at.items()], "node string, x double, y double")
    want, got = plain_push(at, 1.0, 0.001), {r.node: (r.fx, r.fy) for r in forces.push_cells(table, 300, 1.0, 0.001).collect()}
    off = [math.dist(want[n], got[n]) / math.hypot(*want[n]) for n in at if math.hypot(*want[n]) > 50]
    assert len(off) > 100 and sum(off) / len(off) < 0.05
    # two far heaps: each node of one meets all of the other, as masses
    heaps = {f"a{i}": (1e-4 * i, 0.0) for i in range(20)} | {f"b{i}": (1.0 - 1e-4 * i, 0.0) for i in range(20)}
    table = spark.createDataFrame([(n, *p) for n, p in heaps.items()], "node string, x double, y double")
    pushed = forces.push_cells(table, 40, 1.0, 0.001).agg(F.sum("fx")).first()[0]
    assert pushed == pytest.approx(0.0, abs=1e-6)
    near({r.node: (r.fx, r.fy) for r in forces.push_cells(table, 40, 1.0, 0.001).collect()}, plain_push(heaps, 1.0, 0.001), 0.01)
