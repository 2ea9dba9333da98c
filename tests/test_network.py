"""Operators on hand-made graphs whose answers follow by hand."""

import math
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from netspark import queries
from netspark.network import Network, adjacency, parse, from_model, duplicate_edges, from_edges, from_matrix, from_wide, is_symmetric, merge_duplicates, simplify, undirected
from netspark.session import cut
from netspark.operators import cluster, community, degree, flow, layers, layout, local, paths, resample, robustness, select, sequences, spectral, structure


def graph(spark, pairs, directed=False):
    rows = [(*p, 1.0) if len(p) == 2 else p for p in pairs]
    return from_edges(spark.createDataFrame(rows, "src string, dst string, weight double"), directed=directed)


def values(df, digits=9):
    return {r[0]: round(r[1], digits) if isinstance(r[1], float) and not math.isnan(r[1]) else r[1] for r in df.collect()}


TRIANGLE = [("A", "B"), ("A", "C"), ("B", "C")]
FIVE = [("A", "B"), ("A", "C"), ("B", "C"), ("B", "D"), ("C", "D"), ("C", "E"), ("D", "E")]
TREE = [("A", "B"), ("B", "C"), ("C", "D"), ("C", "E")]


def test_triangle(spark):
    net = graph(spark, TRIANGLE)
    assert set(values(degree.degree(net)).values()) == {2}
    assert set(values(local.transitivity_local(net)).values()) == {1.0}
    assert set(values(spectral.pagerank(net), 6).values()) == {round(1 / 3, 6)}
    assert degree.density(net).first()[0] == 1.0
    assert set(values(paths.closeness(net)).values()) == {0.5}
    assert local.clique_size(net).first()[0] == 3
    assert paths.girth(net).first()[0] == 3.0


def test_five_nodes(spark):
    net = graph(spark, FIVE)
    assert values(degree.degree(net)) == {"A": 2, "B": 3, "C": 4, "D": 3, "E": 2}
    assert values(degree.leverage(net))["A"] == round(((2 - 3) / 5 + (2 - 4) / 6) / 2, 9)
    assert values(structure.coreness(net)) == dict.fromkeys("ABCDE", 2)
    b = values(paths.betweenness(net))
    # by hand: A-D through B or C, A-E through C, B-E through C or D
    assert b == {"A": 0.0, "B": 0.5, "C": 2.0, "D": 0.5, "E": 0.0}


def test_tree_structure(spark):
    net = graph(spark, TREE)
    assert {r.node for r in structure.cut_vertices(net).collect()} == {"B", "C"}
    assert {(r.src, r.dst) for r in structure.bridges(net).collect()} == {("A", "B"), ("B", "C"), ("C", "D"), ("C", "E")}
    assert math.isinf(paths.girth(net).first()[0])


def test_load_of_complete_graphs(spark):
    net = graph(spark, [(a, b) for i, a in enumerate("ABCD") for b in "ABCD"[i + 1 :]])
    assert set(values(paths.load(net)).values()) == {7.0}


def test_weighted_betweenness_matches_unit_weights(spark):
    net = graph(spark, FIVE)
    assert values(paths.betweenness(net, weighted=True)) == values(paths.betweenness(net))


def test_ingestion(spark):
    df = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 1.0), (None, "c", 1.0), ("c", "d", 0.0)], "Source string, Target string, value double")
    net = from_edges(df)
    assert net.directed and net.n_edges() == 2
    assert from_edges(spark.createDataFrame([("a", "b")], "i string, j string")).directed is False
    wide = spark.createDataFrame([("x", 0.0, 1.0), ("y", 1.0, 0.0)], "id string, x double, y double")
    assert is_symmetric(from_wide(wide, "id")) and from_matrix(from_wide(wide, "id")).n_edges() == 1
    assert undirected(net).edges.first().weight == 3.0
    assert duplicate_edges(net.edges).first()["count"] == 2
    assert merge_duplicates(net.edges, "mean").first().weight == 1.5
    assert simplify(net, "sum").n_edges() == 2 and adjacency(net).count() == 2


def test_empty_network(spark):
    net = Network(spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string, weight double"), False)
    for made in (degree.degree(net), structure.components(net), local.triangle_count(net), paths.closeness(net)):
        assert made.count() == 0


def test_selection(spark):
    net = graph(spark, [("A", "B", 0.5), ("A", "C", 0.8), ("B", "C", 0.3), ("B", "D", 0.6), ("C", "D", 0.4)])
    pairs = lambda n: {(r.src, r.dst) for r in n.edges.collect()}
    assert pairs(select.filter_edges(net, "weight > 0.5")) == {("A", "C"), ("B", "D")}
    assert sorted(r.weight for r in select.select_edges(net, top=3).edges.collect()) == [0.5, 0.6, 0.8]
    assert len(pairs(select.select_edges(net, involving=["A"]))) == 2
    assert pairs(select.select_edges(net, between=(["A", "B"], ["C", "D"]))) == {("A", "C"), ("B", "C"), ("B", "D")}
    assert {r.node for r in select.filter_nodes(net, "degree >= 3").nodes.collect()} == {"B", "C"}
    assert {r.node for r in select.select_nodes(net, neighbors_of=["A"]).nodes.collect()} == {"A", "B", "C"}
    assert select.named_in("degree > 2 and name = 'pagerank'", select.NODE_METRICS) == ["degree"]


def test_equal_components_go_by_name(spark):
    net = graph(spark, [("A", "B"), ("A", "C"), ("D", "E"), ("E", "F"), ("D", "F")])
    assert {r.node for r in structure.largest_component(net).nodes.collect()} == {"A", "B", "C"}


def test_aggregate_weights(spark):
    df = spark.createDataFrame([(float(i),) for i in (0, 1, 2, 3, 4, 5)], "w double")
    got = df.agg(*[cluster.aggregate_weights(F.col("w"), m, F.lit(10)).alias(m) for m in ("sum", "mean", "median", "max", "min", "prod", "density", "geomean")]).first()
    assert list(got)[:7] == [15, 3, 3, 5, 1, 120, 1.5] and round(got.geomean, 9) == round(120 ** (1 / 5), 9)
    assert df.filter("w < 0").agg(cluster.aggregate_weights(F.col("w")).alias("s")).first().s == 0.0


def test_clusters_and_communities(spark):
    net = graph(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("D", "E"), ("D", "F"), ("E", "F"), ("C", "D", 0.1)])
    groups = spark.createDataFrame([(n, "x" if n in "ABC" else "y") for n in "ABCDEF"], "node string, cluster string")
    member = community.louvain(net)
    assert {r.node for r in member.filter("community = 'A'").collect()} == {"A", "B", "C"}
    assert cluster.compare_partitions(member.withColumnRenamed("community", "cluster"), groups).first().rand == 1.0
    assert cluster.modularity(net, groups.withColumn("cluster", F.lit("one"))).first()[0] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        cluster.check_membership(net, groups.filter("node <> 'A'"))


def test_layers(spark):
    one, two = (spark.createDataFrame(r, "src string, dst string, weight double") for r in ([("1", "2", 1.0), ("2", "3", 1.0)], [("2", "3", 1.0), ("3", "4", 1.0)]))
    s = layers.layer_similarity(one, two, 4).first()
    assert (s.jaccard, s.overlap, s.hamming) == (pytest.approx(1 / 3), 0.5, 2)
    both = one.withColumn("layer", F.lit("a")).unionByName(two.withColumn("layer", F.lit("b")))
    assert layers.aggregate_layers(both, "union").count() == 3 and layers.aggregate_layers(both, "intersection").count() == 1


def test_windows(spark):
    seq = spark.createDataFrame([(1, t, "A") for t in range(1, 11)], "case long, t int, state string")
    starts = lambda size, step: sorted({(r.window) for r in sequences.windows(seq, size, step, 10).collect()})
    assert starts(5, 1) == [0, 1, 2, 3, 4, 5] and starts(5, 5) == [0, 1] and starts(4, 2) == [0, 1, 2, 3]
    none = seq.withColumn("state", F.lit(None).cast("string"))
    assert sequences.usable_windows(none, 5, 1, 10).filter("usable").count() == 0


def test_sequence_queries_read_whole_sequences(spark):
    at = "/root/testdata/sf0.001"
    seq = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{at}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        seq[r.user_id].append(r.event_type)
    last = max(map(len, seq.values()))
    assert last > 20
    for name, step in (("transition_windows_sliding", 1), ("transition_windows_tumbling", 5)):
        want = Counter((k, x, y) for s in seq.values() for k in range((last - 5) // step + 1) for x, y in pairwise(s[k * step : k * step + 5]))
        assert {(r.window, r.src, r.dst): r["count"] for r in queries.QUERIES[name](spark, at).collect()} == want
    gone = lambda t, x: t >= 12 and x in ("purchase", "click", "view")
    share, usable = {}, {}
    for k in range(last - 4):
        w = [gone(t, s[t - 1]) for s in seq.values() for t in range(k + 1, min(k + 5, len(s)) + 1)]
        share[k] = round(sum(w) / len(w), 6)
        usable[k] = all(x <= 0.5 for x in share.values())
    assert {r.window: (r.na_share, r.usable) for r in queries.QUERIES["window_na_stop"](spark, at).collect()} == {k: (pytest.approx(share[k], abs=2e-6), usable[k]) for k in share}
    want = Counter((t, x, y) for s in seq.values() for t, (x, y) in enumerate(pairwise(s), 1))
    assert {(r.step, r.src, r.dst): r["count"] for r in queries.QUERIES["alluvial_flows"](spark, at).collect()} == want
    want = Counter((t, x) for s in seq.values() for t, x in enumerate(s, 1))
    assert {(r.step, r.state): r["count"] for r in queries.QUERIES["node_positions"](spark, at).collect()} == want


def test_layout_and_robustness(spark):
    nodes = spark.createDataFrame([("a",)], "node string")
    assert tuple(layout.layout_circle(nodes).first()) == ("a", 0.5, 0.5)
    star = graph(spark, [("A", "B"), ("A", "C"), ("A", "D")])
    curve = robustness.vertex_attack(star)
    assert [r.comp_size for r in curve.orderBy("step").collect()] == [4, 1, 1, 1, 0]
    assert robustness.auc(curve).first()[0] == pytest.approx(0.125 * 1.25 + 0.25 * 0.25 * 2 + 0.125 * 0.25)


def test_resampling(spark):
    cases = spark.createDataFrame([(c, a, b, 1) for c in range(12) for a, b in (("x", "y"), ("y", "x"), ("x", "x"))], "case long, src string, dst string, count long")
    boot = resample.bootstrap_edges(cases, 20).collect()
    assert {round(r.weight, 6) for r in boot} == {0.5, 1.0} and all(r.ci_lower <= r.mean <= r.ci_upper for r in boot)
    groups = spark.createDataFrame([(c, c % 2) for c in range(12)], "case long, grp int")
    assert all(r["diff"] == 0.0 and r.p_value == 1.0 for r in resample.permutation_edges(cases, groups, 10).collect())


def test_stored_tables_have_their_real_size(spark):
    """A loop that joins its own state must not make the planner's estimate grow."""
    state = cut(spark.range(20).withColumn("x", F.col("id")))
    sizes = []
    for _ in range(15):
        state = cut(state.alias("a").join(state.alias("b"), F.col("a.id") == F.col("b.x")).select("a.id", "b.x"), state)
        sizes.append(int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert max(sizes) < 1 << 16 and state.count() == 20


@pytest.mark.parametrize("method", ["leiden", "label_propagation", "leading_eigenvector"])
def test_two_triangles_fall_apart(spark, method):
    net = graph(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("D", "E"), ("D", "F"), ("E", "F"), ("C", "D", 0.1)])
    groups = defaultdict(set)
    options = {"objective": "modularity"} if method == "leiden" else {}
    for r in community.communities(net, method, **options).collect():
        groups[r.community].add(r.node)
    assert sorted(map(sorted, groups.values())) == [["A", "B", "C"], ["D", "E", "F"]]


def test_current_flow_equals_the_pseudoinverse(spark):
    import numpy as np

    net = graph(spark, [("A", "B", 2.0), ("A", "C", 1.0), ("B", "C", 0.5), ("B", "D", 1.5), ("C", "D", 1.0), ("D", "E", 3.0)])
    names, L = "ABCDE", np.zeros((5, 5))
    for r in net.edges.collect():
        i, j = names.index(r.src), names.index(r.dst)
        L[i, j] = L[j, i] = -r.weight
    L -= np.diag(L.sum(1))
    P, n = np.linalg.pinv(L), 5
    close = {names[i]: (n - 1) / sum(P[i, i] + P[j, j] - 2 * P[i, j] for j in range(n)) for i in range(n)}
    got = values(flow.current_flow_closeness(net, weighted=True), 6)
    assert got == {k: round(v, 6) for k, v in close.items()}
    through = dict.fromkeys(names, 0.0)
    for s in range(n):
        for t in range(s + 1, n):
            p = P[:, s] - P[:, t]
            for v in set(range(n)) - {s, t}:
                through[names[v]] += sum(abs(L[v, u] * (p[v] - p[u])) for u in range(n) if u != v) / 2
    got = values(flow.current_flow_betweenness(net, weighted=True), 6)
    assert got == {k: round(2 * v / ((n - 1) * (n - 2)), 6) for k, v in through.items()}
    apart = graph(spark, [("A", "B"), ("C", "D")])
    assert set(values(flow.current_flow_closeness(apart)).values()) == {None}


def test_voterank(spark):
    star = graph(spark, [("A", "B"), ("A", "C"), ("A", "D"), ("D", "E")])
    rank = values(degree.voterank(star), 6)
    assert rank["A"] == 1.0 and rank["D"] == 0.8 and len(set(rank.values())) == 5


def test_groups_and_parsing(spark):
    net = graph(spark, TRIANGLE)
    groups = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "node string, layers string")
    assert {tuple(r) for r in net.set_groups(groups, "layer").get_groups().collect()} == {("A", "x"), ("B", "x"), ("C", "y")}
    for bad in (groups.limit(2), groups.union(groups.limit(1)), groups.union(spark.createDataFrame([("Z", "x")], groups.schema))):
        with pytest.raises(ValueError):
            net.set_groups(bad)
    assert parse(net) is net and parse((net.nodes, net.edges)).n_edges() == 3
    wide = spark.createDataFrame([("x", 0.0, 1.0), ("y", 1.0, 0.0)], "id string, x double, y double")
    assert parse(wide).n_edges() == 1 and parse(spark.createDataFrame([("a", "b", 2.0)], "from string, to string, w double")).edges.first().weight == 2.0
    model = from_model(spark.createDataFrame([("a", "b", 0.5), ("b", "a", 1.0)], "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0), ("c", 0.0)], "state string, share double"))
    assert values(model.nodes) == {"a": 1.0, "b": 0.0, "c": 0.0} and model.directed
    assert {r.node for r in select.select_nodes(net, index=[1, 3]).nodes.collect()} == {"A", "C"}
    doubled = net.edges.union(net.edges)
    assert merge_duplicates(doubled, lambda w: F.sum(w) * 10).first().weight == 20.0


def test_layouts_stand_where_they_should(spark):
    nodes = lambda n: spark.createDataFrame([(f"n{i}",) for i in range(n)], "node string")
    at = lambda df: {r.node: (round(r.x, 6) + 0.0, round(r.y, 6) + 0.0) for r in df.collect()}
    # clockwise: the last angle first, so the top comes last
    assert at(layout.layout_circle(nodes(4))) == {"n0": (0.9, 0.5), "n1": (0.5, 0.1), "n2": (0.1, 0.5), "n3": (0.5, 0.9)}
    assert at(layout.layout_circle(nodes(4), clockwise=False))["n0"] == (0.5, 0.9)
    assert at(layout.layout_grid(nodes(5))) == {"n0": (0.1, 0.9), "n1": (0.5, 0.9), "n2": (0.9, 0.9), "n3": (0.1, 0.1), "n4": (0.5, 0.1)}
    assert at(layout.layout_grid(nodes(1))) == at(layout.layout_star(nodes(1))) == {"n0": (0.5, 0.5)}
    one = spark.createDataFrame([("a", "g"), ("b", "g")], "node string, cluster string")
    assert at(layout.layout_groups(one)) == {"a": (0.5, 0.65), "b": (0.5, 0.35)}
    assert at(layout.layout_bipartite(nodes(3))) == {"n0": (0.2, 0.9), "n1": (0.8, 0.9), "n2": (0.2, 0.1)}
    assert at(layout.rescale(layout.layout_grid(nodes(2)))) == {"n0": (-0.36, 0.0), "n1": (0.36, 0.0)}
    layout.register("mine", layout.layout_grid)
    assert layout.get("mine") is layout.layout_grid and "mine" in layout.names()
    with pytest.raises(ValueError):
        layout.get("none")


def test_loops_count_where_the_matrix_counts_them(spark):
    edges = spark.createDataFrame([("A", "A", 2.0), ("A", "B", 1.0), ("B", "C", 4.0), ("C", "A", 1.0), ("C", "C", 3.0)], "src string, dst string, weight double")
    net = from_edges(edges, directed=True)
    groups = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "node string, cluster string")
    got = {r.cluster: r for r in cluster.cluster_quality(net, groups).collect()}
    assert (got["x"].internal_edges, got["x"].cut_edges, got["x"].internal_density) == (3.0, 5.0, 1.5)
    assert (got["y"].internal_edges, got["y"].internal_density, got["y"].conductance) == (3.0, None, 5 / 11)
    p = {(r.src, r.dst): round(r.p, 9) for r in layers.disparity(net).collect()}
    assert p == {("A", "B"): round(1 - 1 / 3, 9), ("B", "C"): round(min(1.0, 1 - 4 / 7), 9), ("C", "A"): round(min(1 - 1 / 4, 1 - 1 / 3), 9)}
    # A: itself, B and C are its neighbours
    assert values(degree.diffusion(net))["A"] == 4 + (4 + 2 + 4)
    assert values(degree.leverage(net))["A"] == round((0 + 2 / 6 + 0) / 3, 9)


def test_golden_graphs(spark):
    """Girth, radius, largest clique, cut vertices and bridges of named graphs."""
    name = lambda i: f"n{i:02d}"
    ring = lambda n: [(name(i), name((i + 1) % n)) for i in range(n)]
    path = lambda n: [(name(i), name(i + 1)) for i in range(n - 1)]
    petersen = [(name(i), name((i + 1) % 5)) for i in range(5)] + [(name(i), name(i + 5)) for i in range(5)] + [(name(i + 5), name((i + 2) % 5 + 5)) for i in range(5)]
    grid = [(name(3 * i + j), name(3 * i + j + 1)) for i in range(3) for j in range(2)] + [(name(3 * i + j), name(3 * i + j + 3)) for i in range(2) for j in range(3)]
    golden = [
        ([(name(i), name(j)) for i in range(5) for j in range(i + 1, 5)], 3, 1, 5, 0, 0), (path(5), math.inf, 2, 2, 3, 4), (ring(5), 5, 2, 2, 0, 0),
        ([(name(0), name(i)) for i in range(1, 6)], math.inf, 1, 2, 1, 5), (grid, 4, 2, 2, 0, 0), (petersen, 5, 2, 2, 0, 0),
    ]
    for pairs, girth, radius, clique, cuts, bridges in golden:
        net = graph(spark, pairs)
        assert (paths.girth(net).first()[0], paths.path_summary(net).first().radius, local.clique_size(net).first()[0]) == (girth, radius, clique)
        assert (structure.cut_vertices(net).count(), structure.bridges(net).count()) == (cuts, bridges)


def test_sliding_windows_go_on_where_most_cases_have_ended(spark):
    at = "/root/testdata/sf0.001"
    last = spark.read.parquet(f"{at}/events.parquet").groupBy("user_id").count().agg({"count": "max"}).first()[0]
    assert queries.QUERIES["transition_windows_sliding"](spark, at).agg({"window": "max"}).first()[0] == last - 5
