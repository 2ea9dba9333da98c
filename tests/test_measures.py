"""Cuts, random networks, colours, points and resampling against brute force and values that follow by hand."""

from collections import Counter
from fractions import Fraction
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark import queries
from netspark.functions import colors, geometry, scales
from netspark.operators import connectivity, draws, layers, local, nulls, resample, spectral
from netspark.plans import summary

from .test_network import FIVE, TREE, TRIANGLE, graph, values

K4 = [("A", "B"), ("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"), ("C", "D")]
CUBE = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "e"), ("a", "e"), ("b", "f"), ("c", "g"), ("d", "h")]


def reaches(nodes, arcs, s, t):
    seen, todo = {s}, [s]
    while todo:
        u = todo.pop()
        for v in arcs.get(u, ()):
            if v in nodes and v not in seen:
                seen.add(v)
                todo.append(v)
    return t in seen


def held(nodes, edges, directed):
    arcs = {}
    for u, v in edges:
        arcs.setdefault(u, []).append(v)
        if not directed:
            arcs.setdefault(v, []).append(u)
    return all(reaches(nodes, arcs, s, t) for s, t in permutations(nodes, 2))


def fewest_edges(nodes, edges, directed):
    return next(k for k in range(len(edges) + 1) for gone in combinations(edges, k) if not held(nodes, [e for e in edges if e not in gone], directed))


def fewest_nodes(nodes, edges, directed):
    for k in range(len(nodes) - 1):
        for gone in combinations(sorted(nodes), k):
            if not held(nodes - set(gone), edges, directed):
                return k
    return len(nodes) - 1


@pytest.mark.parametrize("edges, directed", [(FIVE, False), (TREE, False), (K4, False), (CUBE, False), ([("A", "B"), ("B", "C"), ("C", "A"), ("A", "C"), ("C", "D"), ("D", "A"), ("D", "B")], True), ([*TRIANGLE, ("X", "Y")], False)])
def test_cuts_equal_brute_force(spark, edges, directed):
    net, nodes = graph(spark, edges, directed), {v for e in edges for v in e}
    assert connectivity.min_cut(net).first()[0] == fewest_edges(nodes, edges, directed)
    assert connectivity.vertex_connectivity(net).first()[0] == fewest_nodes(nodes, edges, directed)


def test_cuts_of_almost_nothing(spark):
    none = graph(spark, TRIANGLE).with_nodes(spark.createDataFrame([("A",)], "node string"))
    for net in (none, none.with_nodes(none.nodes.limit(0))):
        assert connectivity.min_cut(net).first()[0] == connectivity.vertex_connectivity(net).first()[0] == 0


@pytest.mark.parametrize("m", [0, 5, 20, 45])
def test_networks_of_the_same_size(spark, m):
    made = [tuple(r) for r in nulls.same_size(spark, 10, m, 6).collect()]
    assert Counter(r[0] for r in made) == ({r: m for r in range(6)} if m else {})
    assert len(set(made)) == len(made) and all(0 <= a < b < 10 for _, a, b in made)
    assert sorted(made) == sorted(tuple(r) for r in nulls.same_size(spark, 10, m, 6).collect())


def test_networks_with_the_same_degrees(spark):
    net = graph(spark, CUBE + [("a", "c"), ("a", "f")])
    made = [tuple(r) for r in nulls.same_degrees(net, 4, 6).collect()]
    assert len(set(made)) == len(made) == 4 * 14 and all(a < b for _, a, b in made)
    wanted = Counter(v for e in CUBE + [("a", "c"), ("a", "f")] for v in e)
    for run in range(4):
        edges = [e[1:] for e in made if e[0] == run]
        assert Counter(v for e in edges for v in e) == wanted
        assert set(edges) != {tuple(sorted(e)) for e in CUBE + [("a", "c"), ("a", "f")]}


def closed_and_far(edges, nodes):
    near = {v: {w for e in edges if v in e for w in e if w != v} for v in nodes}
    triples = sum(len(n) * (len(n) - 1) / 2 for n in near.values())
    closed = sum(1 for v in nodes for a, b in combinations(near[v], 2) if b in near[a])
    far = []
    for s in nodes:
        dist, todo = {s: 0}, [s]
        for u in todo:
            for v in near[u] - set(dist):
                dist[v] = dist[u] + 1
                todo.append(v)
        far += [d for v, d in dist.items() if v != s]
    return closed / triples, sum(far) / len(far)


def test_small_world_equals_brute_force(spark):
    net = graph(spark, CUBE + [("a", "c"), ("a", "f")])
    c, far = closed_and_far([tuple(e) for e in CUBE + [("a", "c"), ("a", "f")]], set("abcdefgh"))
    chance = [closed_and_far([(r[1], r[2]) for r in nulls.same_size(spark, 8, 14, 3).collect() if r[0] == run], set(range(8))) for run in range(3)]
    rc, rl = (sum(x[i] for x in chance) / 3 for i in (0, 1))
    assert nulls.small_world(net, 3).first()[0] == pytest.approx((c / rc) / (far / rl))
    assert nulls.small_world(graph(spark, TRIANGLE)).first()[0] is None
    assert nulls.small_world(graph(spark, TREE)).first()[0] is None


def test_rich_club_against_the_same_degrees(spark):
    row = nulls.rich_club_ratio(graph(spark, FIVE), k=2, runs=3, rounds=3).first()
    assert (row.n, row.m, row.phi) == (3, 3, 1.0) and row.ratio >= 1.0
    assert local.rich_club(graph(spark, FIVE), 2).first().phi == 1.0


def test_colours(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 5.0), ("c", 10.0), ("d", None)], "node string, v double")
    assert values(colors.scale_color(df, "v", ["#FF0000", "#0000FF"]).select("node", "color")) == {"a": "#FF0000", "b": "#7F007F", "c": "#0000FF", "d": None}
    assert values(colors.scale_color(df, "v", ["#FF0000", "#0000FF"], limits=(5, 10)).select("node", "color"))["a"] == "#FF0000"
    assert {r.color for r in colors.scale_color(df.filter("v is null"), "v", ["#FF0000"]).collect()} == {"gray50"}
    assert values(colors.color_levels(df, "node", ["#111111", "#222222"]).select("node", "color")) == {"a": "#111111", "b": "#222222", "c": "#111111", "d": "#222222"}
    many = spark.range(9).selectExpr("cast(id as string) as level")
    found = values(colors.color_levels(many, "level"))
    assert found["0"] == colors.COLORBLIND[0] and found["8"] == colors.COLORBLIND[-1] and len(set(found.values())) == 9
    one = spark.createDataFrame([("#204060",), ("red",), (None,), ("#FFFFFF",)], "c string")
    rows = one.select(colors.with_alpha(F.col("c"), 0.5).alias("a"), colors.brighten(F.col("c"), 0.5).alias("b"), colors.brighten(F.col("c"), -0.5).alias("d"), colors.text_on(F.col("c")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("#20406080", "#8F9FAF", "#102030", "white"), ("red", None, None, "black"), (None, None, None, "black"), ("#FFFFFF80", "#FFFFFF", "#7F7F7F", "black")]


def test_points_and_curves(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0), (1.0, 1.0, 1.0, 1.0)], "ax double, ay double, bx double, by double")
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    mid = geometry.control(a, b, 0.5)
    row = df.select(geometry.distance(a, b), geometry.angle(a, b), *mid, *geometry.toward(a, b, 1.0), *geometry.border(b, a, 1.0)).first()
    assert [round(x, 9) for x in row] == [4.0, 0.0, 2.0, 2.0, 1.0, 0.0, 3.0, 0.0]
    assert tuple(df.filter("ax = 1").select(*mid).first()) == (1.0, 1.0)
    curve = sorted((r.step, r.x, r.y) for r in geometry.bezier(df.filter("ax = 0"), a, mid, b, 3).collect())
    assert curve == [(0, 0.0, 0.0), (1, 2.0, 1.0), (2, 4.0, 0.0)]


def test_edges_side_by_side(spark):
    net = graph(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("C", "C")], directed=True)
    assert {(r.src, r.dst): r.curve for r in scales.curvatures(net.edges).collect()} == {("A", "B"): 0.2, ("B", "A"): 0.2, ("B", "C"): 0.0, ("C", "C"): 0.0}
    found = {(r.src, r.dst): r.betweenness for r in summary.edge_centrality(net).collect()}
    assert found == {("A", "B"): 2.0, ("B", "A"): 1.0, ("B", "C"): 2.0, ("C", "C"): 0.0}
    short = {(r.src, r.dst): r.betweenness for r in summary.edge_centrality(net, cutoff=1).collect()}
    assert short == {("A", "B"): 1.0, ("B", "A"): 1.0, ("B", "C"): 1.0, ("C", "C"): 0.0}
    cells = spark.createDataFrame([("x", "A", "B", 1.0), ("y", "A", "B", 3.0), ("y", "B", "C", 2.0)], "layer string, src string, dst string, weight double")
    assert sorted(tuple(r) for r in layers.differences(cells).collect()) == [("x", "y", "A", "B", 1.0, 3.0, -2.0), ("x", "y", "B", "C", 0.0, 2.0, -2.0)]
    sizes = values(summary.node_sizes(graph(spark, TREE), "degree").select("node", "size"))
    assert sizes == {"A": 2.0, "B": 5.0, "C": 8.0, "D": 2.0, "E": 2.0}
    assert set(values(summary.node_sizes(graph(spark, TRIANGLE), "degree").select("node", "size")).values()) == {5.0}


def test_replicates(spark):
    cases = spark.createDataFrame([(c, s, d, 1 + (c * 7 + len(s + d)) % 3) for c in range(40) for s, d in (("a", "b"), ("b", "a"), ("a", "aa"))], "case int, src string, dst string, count int")
    at = sorted(r.at for r in draws.numbered(cases).collect())
    assert at == list(range(40))
    boot = {(r.src, r.dst): r for r in resample.bootstrap_edges(cases, 100).collect()}
    assert boot[("b", "a")].weight == 1.0 and boot[("b", "a")].sd == 0.0
    assert all(r.ci_lower <= r.mean <= r.ci_upper and abs(r.mean - r.weight) < 0.05 for r in boot.values())
    groups = cases.select("case", (F.col("case") % 2).alias("grp")).distinct()
    pairs = cases.select("case", F.floor(F.col("case") / 2).alias("pair")).distinct()
    twins = cases.withColumn("count", F.lit(2))  # both of a pair alike: no swap changes anything
    still = resample.permutation_edges(twins, groups, 20, pairs=pairs).collect()
    assert {(r.diff, r.p_value) for r in still} == {(0.0, 1.0)}
    plain = {(r.src, r.dst): r.p_value for r in resample.permutation_edges(cases, groups, 50, pairs=pairs).collect()}
    fixed = {(r.src, r.dst): r.p_value for r in resample.permutation_edges(cases, groups, 50, pairs=pairs, correction="bonferroni").collect()}
    assert fixed == {k: min(1.0, p * len(plain)) for k, p in plain.items()}


def test_stability_of_cases_that_are_alike(spark):
    """Betweenness is 1, 1 and 0; the shares of a node's own edges always add to 1, so they tell nothing."""
    rows = [(c, s, d, n) for c in range(12) for s, d, n in (("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 4), ("b", "a", 3))]
    found = values(resample.stability(spark.createDataFrame(rows, "case int, src string, dst string, count int"), (0.1, 0.5), 4))
    assert found == {"InStrength": 0.5, "OutStrength": 0.0, "Betweenness": 0.5}


#: Two edges leave each node, 1 is an eigenvalue, and its eigenvector does not sum to 0.
SINGULAR = ["AD", "AE", "BC", "BE", "CB", "CF", "DA", "DE", "EB", "EF", "FB", "FE"]


def test_alpha_next_to_a_singular_system(spark):
    net = graph(spark, SINGULAR, directed=True)
    with pytest.raises(RuntimeError):
        spectral.alpha_centrality(net, 1.0).collect()
    table = np.array([[float(a + b in SINGULAR) for b in "ABCDEF"] for a in "ABCDEF"])
    want = np.linalg.solve(np.eye(6) - 1.0000000001 * table.T, np.ones(6))
    got = {r.node: r.alpha for r in spectral.alpha_centrality(net, 1.0000000001).collect()}
    assert [got[a] for a in "ABCDEF"] == pytest.approx(list(want), rel=1e-5)


def test_power_next_to_a_singular_system(spark):
    """Where all nodes have as many neighbours, all have the same power."""
    got = {r.node: r.power for r in spectral.power_centrality(graph(spark, SINGULAR, directed=True), 1.0000000001).collect()}
    assert got == pytest.approx(dict.fromkeys("ABCDEF", -1.0), abs=1e-4)


def test_alpha_where_values_reach_1e19(spark):
    """1 is an eigenvalue twice over, so the pivots fall to 1e-20; the expected values are fractions."""
    edges = ["AG", "AF", "BC", "BE", "CA", "CD", "DC", "DG", "EF", "EB", "FG", "FA", "GF", "GA"]
    table = [[Fraction(a == b) - Fraction(1.0000000001) * (b + a in edges) for b in "ABCDEFG"] + [Fraction(1)] for a in "ABCDEFG"]
    for k in range(7):
        at = next(i for i in range(k, 7) if table[i][k])
        table[k], table[at] = table[at], table[k]
        table[k] = [x / table[k][k] for x in table[k]]
        table = [row if i == k else [x - row[k] * y for x, y in zip(row, table[k])] for i, row in enumerate(table)]
    got = {r.node: r.alpha for r in spectral.alpha_centrality(graph(spark, edges, directed=True), 1.0000000001).collect()}
    assert [got[a] for a in "ABCDEFG"] == pytest.approx([float(row[-1]) for row in table], rel=1e-9)
    assert max(map(abs, got.values())) > 1e19


def test_alpha_default_has_the_digits_of_its_sql(spark, tmp_path):
    """Next to a singular system the values reach 1e9, and their last digits hang on the order of the operations."""
    duckdb = pytest.importorskip("duckdb")
    edges = ["AF", "AD", "BD", "BC", "CB", "CF", "DC", "DE", "EF", "EA", "FE", "FA"]
    own = list(enumerate("ABCDEF"))
    tables = {
        "nation": (own, "n_nationkey int, n_name string"), "supplier": ([(i, i) for i, _ in own], "s_suppkey int, s_nationkey int"),
        "customer": ([(i, i) for i, _ in own], "c_custkey int, c_nationkey int"), "orders": ([(i, i) for i, _ in own], "o_orderkey int, o_custkey int"),
        "lineitem": ([("ABCDEF".index(b), "ABCDEF".index(a), 1.0, "N") for a, b in edges], "l_orderkey int, l_suppkey int, l_quantity double, l_returnflag string"),
    }
    base = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = dict(base.execute(queries.ORACLE_SQL["alpha_centrality_default"]).fetchall())
    assert len(want) == 6 and max(map(abs, want.values())) > 1e9
    assert {r.node: r.alpha for r in queries.QUERIES["alpha_centrality_default"](spark, str(tmp_path)).collect()} == want


def test_power_where_pivots_are_rounding(spark):
    """Two edges leave each node, so all have the same power; 1 is an eigenvalue twice over."""
    for edges in ("AG AC BD BG CA CE DB DG EG EF FE FG GD GE", "AG AF BC BE CA CD DC DG EF EB FG FA GF GA", "AE AD BF BH CA CH DA DE EA EB FB FH GD GC HC HF"):
        got = {r.node: r.power for r in spectral.power_centrality(graph(spark, edges.split(), directed=True), 1.0000000001).collect()}
        assert got == pytest.approx(dict.fromkeys(sorted({a for e in edges.split() for a in e}), -1.0), abs=1e-9)


def test_alpha_at_one_over_an_eigenvalue(spark):
    """1/3 is no double, so the system has a solution of some 1e16 that hangs on the last digit: that is none."""
    with pytest.raises(RuntimeError):
        spectral.alpha_centrality(graph(spark, ["AB", "AC", "AD", "BC", "BD", "CD"]), 1 / 3).collect()
