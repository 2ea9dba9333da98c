"""Bridges, cut vertices and blocks against removal; attack curves against deleting step by step; running totals."""

import itertools
import random

import pytest

from netspark.network import Network
from netspark import queries
from netspark.operators import blocks, robustness, structure
from netspark.operators.ordered import running


def network(spark, nodes, edges):
    return Network(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, weight double"), False)


def parts(nodes, edges):
    """Components as sets."""
    left, out = set(nodes), []
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    while left:
        seen, stack = set(), [min(left)]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += near[x] - seen
        out.append(seen)
        left -= seen
    return out


def some_graphs():
    rng = random.Random(3)
    yield ["a", "b", "c"], []
    yield list("abcdefgh"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("h", "h")]
    yield [f"p{i:02}" for i in range(7)], [(f"p{i:02}", f"p{i + 1:02}") for i in range(6)]
    yield [f"s{i:03}" for i in range(90)], [("s000", f"s{i:03}") for i in range(1, 90)] + [("s001", "s002"), ("s002", "s003")]
    for n, m in ((14, 16), (20, 24)):
        nodes = [f"n{i:02}" for i in range(n)]
        pairs = rng.sample(list(itertools.combinations(nodes, 2)), m)
        yield nodes, pairs + [pairs[0], (pairs[1][1], pairs[1][0])]


def test_bridges_cut_vertices_and_blocks_equal_removal(spark):
    """All graphs side by side, as one network in several parts."""
    graphs = [([f"{i}{n}" for n in nodes], [(f"{i}{a}", f"{i}{b}") for a, b in edges]) for i, (nodes, edges) in enumerate(some_graphs())]
    net = network(spark, [n for g in graphs for n in g[0]], [e for g in graphs for e in g[1]])
    found_bridges, found_cuts = {tuple(r) for r in structure.bridges(net).collect()}, {r.node for r in structure.cut_vertices(net).collect()}
    of, forest = {(r.src, r.dst): r.block for r in blocks.blocks(net).collect()}, {r.node: r for r in blocks.spanning_forest(net).collect()}
    seen = set()
    for nodes, edges in graphs:
        n, simple = len(parts(nodes, edges)), sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
        once = [p for p in simple if sum({*p} == {*e} for e in edges) == 1]
        assert {p for p in found_bridges if p[0] in nodes} == {p for p in once if len(parts(nodes, [e for e in simple if e != p])) > n}
        linked = {x for p in simple for x in p}
        cuts = {v for v in linked if len(parts([x for x in nodes if x != v], simple)) > n}
        assert found_cuts & set(nodes) == cuts
        whole, without = parts(nodes, simple), {v: parts([x for x in nodes if x != v], simple) for v in cuts}
        for e, f in itertools.combinations(simple if len(simple) < 60 else simple[:12], 2):
            # edges are in different blocks if some node parts them
            part = lambda e, v: next(i for i, c in enumerate(without[v]) if ({*e} - {v}) & c)  # noqa: B023, E731
            together = any(({*e} | {*f}) <= c for c in whole) and not any(part(e, v) != part(f, v) for v in cuts)
            assert (of[e] == of[f]) == together, (e, f)
        seen |= set(simple)
        for tree in parts(linked, simple):
            assert sorted(forest[x].pre for x in tree) == list(range(len(tree)))
            ups = {x: {y.node for y in above(forest[x], forest)} for x in tree}
            for x in tree:
                below = [forest[y] for y in tree if x in ups[y]]
                assert forest[x].size == len(below) and all(forest[x].pre <= y.pre < forest[x].pre + forest[x].size for y in below)
    assert set(of) == seen and set(forest) == {x for e in seen for x in e}


def above(row, forest):
    while True:
        yield row
        if row.parent is None:
            return
        row = forest[row.parent]


def curve_by_deletion(nodes, edges, order, by):
    out, nodes, edges = [max(map(len, parts(nodes, edges)))], list(nodes), list(edges)
    for x in order:
        if by == "vertex":
            nodes.remove(x)
            edges = [e for e in edges if x not in e]
        else:
            edges.remove(x)
        out.append(max(map(len, parts(nodes, edges)), default=0))
    return out if by == "vertex" else [*out[:-1], 0]


@pytest.mark.parametrize("by", ["vertex", "edge"])
def test_attack_curves_equal_deletion(spark, by):
    rng = random.Random(5)
    nodes = [f"n{i:02}" for i in range(13)]
    edges = sorted(rng.sample(list(itertools.combinations(nodes[:-1], 2)), 17))
    net = network(spark, nodes, edges)
    things = net.nodes.select("node") if by == "vertex" else net.simple()
    ranks, curves = robustness.random_ranks(things, 5, 7).collect(), []
    for run in range(5):
        own = sorted((r["rank"], r.node if by == "vertex" else (r.src, r.dst)) for r in ranks if r.run == run)
        assert [r[0] for r in own] == list(range(1, len(nodes if by == "vertex" else edges) + 1))
        curves.append(curve_by_deletion(nodes, edges, [r[1] for r in own], by))
    assert len({tuple(c) for c in curves}) > 1
    got = robustness.random_attack(net, 5, 7, by).orderBy("step").collect()
    assert [r.comp_size for r in got] == pytest.approx([sum(c) / 5 for c in zip(*curves, strict=True)])


def test_targeted_attacks(spark):
    nodes, edges = list("abcdefg"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "f"), ("b", "g")]
    net = network(spark, nodes, edges)
    left, order = list(edges), []
    for _ in nodes:
        degree = {n: sum(n in e for e in left) for n in nodes if n not in order}
        order.append(min(degree, key=lambda n: (-degree[n], n)))
        left = [e for e in left if order[-1] not in e]
    assert robustness.degree_order(net) == order
    got = robustness.robustness(net).orderBy("step").collect()
    assert [r.comp_size for r in got] == curve_by_deletion(nodes, edges, order, "vertex")
    assert [r.removed_pct for r in got] == pytest.approx([i / 7 for i in range(8)]) and got[0].comp_pct == 1.0
    line = network(spark, list("abcd"), [("a", "b"), ("b", "c"), ("c", "d")])
    assert [r.comp_size for r in robustness.robustness(line, "betweenness").orderBy("step").collect()] == [4, 2, 2, 1, 0]
    assert [r.comp_size for r in robustness.robustness(line, "betweenness", "edge").orderBy("step").collect()] == [4, 2, 2, 0]
    for bad in (("degree", "edge"), ("size", "vertex")):
        with pytest.raises(ValueError):
            robustness.robustness(line, *bad)


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.random(), i, rng.randrange(10)) for i in range(500)] + [(None, 1000, 1)]
    table = spark.createDataFrame(rows, "k double, i int, v int").repartition(7)
    got = running(running(table, ["k", "i"], "v", "sum"), ["k", "i"], name="at").collect()
    total, want = 0, {}
    for at, (_, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1):
        total += v
        want[i] = (total, at)
    assert {r.i: (r["sum"], r["at"]) for r in got} == want


def _apart(nodes, edges):
    """How many components nodes and edges make."""
    of = {a: a for a in nodes}
    for a, b in edges:
        x, y = of[a], of[b]
        of = {k: y if o == x else o for k, o in of.items()}
    return len(set(of.values()))


def test_thinned_networks_and_rings_keep_cuts(spark, tmp_path, monkeypatch):
    from netspark.operators import components
    from netspark.sources import tables

    monkeypatch.setattr(components, "THIN", 0)
    monkeypatch.setattr(components, "KEPT", 1)
    orders = [[g * 8 + (i * k) % 8 for i in range(3 + k)] for g in range(3) for k in (1, 3, 4)] + [[3, 8], [8, 3], [20, 30], [30, 31, 32, 33, 34], [40, 41], [50]]
    parts = sorted({p for o in orders for p in o})
    spark.createDataFrame([(i, p) for i, o in enumerate(orders) for p in o], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    edges = {(min(a, b), max(a, b)) for o in orders for a in set(o) for b in set(o) if a != b}
    all_ = _apart(parts, edges)
    at = str(tmp_path)
    got = {(r.src, r.dst) for r in queries.QUERIES["bridges_copurchase"](spark, at).collect()}
    assert got == {e for e in edges if _apart(parts, edges - {e}) > all_} and len(got) > 2
    got = {r.node for r in queries.QUERIES["cut_vertices_copurchase"](spark, at).collect()}
    assert got == {p for p in parts if _apart(set(parts) - {p}, [e for e in edges if p not in e]) > all_} and got
    assert sum(r.nodes for r in queries.QUERIES["components_copurchase"](spark, at).collect()) == len(parts)
    assert queries.QUERIES["components_copurchase"](spark, at).count() == all_
    assert tables.co_purchase_rings(spark, at).edges.count() < len(edges)
