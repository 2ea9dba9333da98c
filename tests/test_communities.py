"""Communities against plain versions, exhaustive search and their objectives."""

import itertools
import math
import random

import pytest

from netspark.network import Network
from netspark.operators import community, fluid, infomap, optimal, spinglass, walktrap


def network(spark, edges, directed=False, nodes=()):
    names = sorted({x for e in edges for x in e[:2]} | set(nodes))
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
    return Network(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(rows, "src string, dst string, weight double"), directed)


def random_edges(seed, n=12, m=20):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(n)]
    return [(a, b, rng.choice([1, 2, 3.5])) for a, b in rng.sample(list(itertools.combinations(nodes, 2)), m)]


def two_blocks(k=5, bridges=1):
    one, two = [f"a{i}" for i in range(k)], [f"b{i}" for i in range(k)]
    return [*itertools.combinations(one, 2), *itertools.combinations(two, 2), *zip(one[:bridges], two[:bridges], strict=True)]


def groups(member):
    out = {}
    for r in member.collect():
        out.setdefault(r.community, set()).add(r.node)
    assert all(name == min(members) for name, members in out.items())
    return {frozenset(g) for g in out.values()}


def modularity(edges, parts):
    of = {x: i for i, p in enumerate(parts) for x in p}
    m = sum(e[2] if len(e) > 2 else 1 for e in edges)
    k, inside = {}, 0.0
    for a, b, *w in edges:
        w = w[0] if w else 1
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += w * (of[a] == of[b])
    return inside / m - sum((sum(k.get(x, 0) for x in p) / (2 * m)) ** 2 for p in parts)


def partitions(items):
    if not items:
        yield []
        return
    head, *rest = items
    for p in partitions(rest):
        yield [[head], *p]
        for i in range(len(p)):
            yield [*p[:i], [head, *p[i]], *p[i + 1 :]]


# --- walktrap --------------------------------------------------------------------


def plain_walktrap(edges, nodes, steps=4):
    """Merges of the neighbouring pair with the least addition, one at a time: heights and the partition of highest modularity."""
    near = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    arcs = {n: {**near[n], n: (sum(near[n].values()) / len(near[n]) if near[n] else 1.0)} for n in nodes}
    d = {n: sum(arcs[n].values()) for n in nodes}
    walk = {n: {n: 1.0} for n in nodes}
    for _ in range(steps):
        for n in nodes:
            new = {}
            for k, x in walk[n].items():
                for j, w in arcs[k].items():
                    new[j] = new.get(j, 0) + x * w / d[k]
            walk[n] = new
    at, size = {n: {k: x / math.sqrt(d[k]) for k, x in walk[n].items()} for n in nodes}, dict.fromkeys(nodes, 1)
    of, ties = {n: {n} for n in nodes}, {(a, b) for a in nodes for b in near[a] if a < b}

    def spread(a, b):
        r2 = sum((at[a].get(k, 0) - at[b].get(k, 0)) ** 2 for k in {*at[a], *at[b]})
        return size[a] * size[b] / (size[a] + size[b]) * r2 / len(nodes)

    best, top, heights = (modularity(edges, list(of.values())), [set(x) for x in of.values()]), 0.0, []
    while ties:
        delta, a, b = min((round(spread(a, b), 12), a, b) for a, b in ties)
        top = max(top, delta)
        heights.append(delta)
        at[a] = {k: (size[a] * at[a].get(k, 0) + size[b] * at[b].get(k, 0)) / (size[a] + size[b]) for k in {*at[a], *at[b]}}
        size[a] += size[b]
        of[a] |= of.pop(b)
        ties = {(min(x, y), max(x, y)) for x, y in ((a if p == b else p, a if q == b else q) for p, q in ties) if x != y}
        q = modularity(edges, list(of.values()))
        if q > best[0] + 1e-12:
            best = q, [set(x) for x in of.values()]
    return heights, best


def test_walktrap_equals_one_merge_at_a_time(spark):
    for seed in (0, 3):
        edges = random_edges(seed, 10, 15)
        net = network(spark, edges, nodes=["alone"])
        nodes = sorted({x for e in edges for x in e[:2]} | {"alone"})
        heights, (q, parts) = plain_walktrap(edges, nodes)
        tree = walktrap.merges(net).orderBy("step").collect()
        assert len(tree) == len(heights) and [r.step for r in tree] == list(range(1, len(tree) + 1))
        found = groups(walktrap.walktrap(net))
        assert modularity(edges, found) == pytest.approx(max(r.modularity for r in tree), abs=1e-9)
        if heights == sorted(heights):  # where heights never fall, the dendrograms are the same
            assert sorted(r.height for r in tree) == pytest.approx(heights, abs=1e-9)
            assert found == {frozenset(p) for p in parts} or modularity(edges, found) == pytest.approx(q)
    assert groups(walktrap.walktrap(network(spark, [("a", "a", 1)]))) == {frozenset("a")}


# --- infomap ----------------------------------------------------------------------


def plain_code_length(edges, nodes, parts, directed, jump=0.15):
    out = {n: {} for n in nodes}
    for a, b, w in edges:
        out[a][b] = out[a].get(b, 0) + w
        if not directed:
            out[b][a] = out[b].get(a, 0) + w
    p, n = dict.fromkeys(nodes, 1 / len(nodes)), len(nodes)
    for _ in range(3000):
        lost = sum(p[x] * (jump if out[x] else 1.0) for x in nodes)
        new = dict.fromkeys(nodes, lost / n)
        for x in nodes:
            for y, w in out[x].items():
                new[y] += (1 - jump) * p[x] * w / sum(out[x].values())
        p = new
    of = {x: i for i, g in enumerate(parts) for x in g}
    log = lambda x: x * math.log2(x) if x > 1e-300 else 0.0
    q = [0.0] * len(parts)
    for x in nodes:
        q[of[x]] += p[x] * (jump if out[x] else 1.0) * (1 - len(parts[of[x]]) / n)
        for y, w in out[x].items():
            q[of[x]] += (1 - jump) * p[x] * w / sum(out[x].values()) * (of[x] != of[y])
    held = [sum(p[x] for x in g) for g in parts]
    return log(sum(q)) - 2 * sum(map(log, q)) - sum(map(log, p.values())) + sum(log(a + b) for a, b in zip(q, held, strict=True))


@pytest.mark.parametrize("directed", [True])
def test_code_length_and_its_optimum(spark, directed):
    rng = random.Random(6)
    edges = [(a, b, rng.choice([1, 2, 5])) for a, b in rng.sample(list(itertools.permutations("abcdefg", 2)), 12)]
    nodes, net = list("abcdefg"), network(spark, edges, directed, "abcdefg")
    some = [["a", "b"], ["c", "d", "e"], ["f", "g"]]
    member = spark.createDataFrame([(x, str(i)) for i, g in enumerate(some) for x in g], "node string, community string")
    assert infomap.code_length(net, member).first().bits == pytest.approx(plain_code_length(edges, nodes, some, directed), abs=1e-6)
    best = min(plain_code_length(edges, nodes, p, directed) for p in partitions(nodes))
    found = [sorted(g) for g in groups(infomap.infomap(net, nb_trials=3))]  # all trials are one union
    assert plain_code_length(edges, nodes, found, directed) <= best + 0.05


def test_infomap_finds_blocks(spark):
    net = network(spark, two_blocks(6))
    assert groups(infomap.infomap(net, nb_trials=2, recorded=False)) == {frozenset(f"{c}{i}" for i in range(6)) for c in "ab"}


# --- leiden -----------------------------------------------------------------------


def cpm(edges, parts, gamma, size=None):
    of = {x: i for i, p in enumerate(parts) for x in p}
    size = size or {}
    inside = sum(w for a, b, w in edges if of[a] == of[b])
    return inside - gamma * sum(sum(size.get(x, 1) for x in p) ** 2 for p in parts) / 2


def connected(edges, part):
    seen, stack = set(), [min(part)]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += [b if a == x else a for a, b, _ in edges if x in (a, b) and {a, b} <= set(part)]
    return seen == set(part)


def test_leiden_by_constant_potts(spark):
    blocks = network(spark, two_blocks(5, 2))
    found = groups(community.leiden(blocks, resolution=0.5))
    edges = [(a, b, 1.0) for a, b in two_blocks(5, 2)]
    assert found == {frozenset(f"{c}{i}" for i in range(5)) for c in "ab"}
    assert all(connected(edges, g) for g in found) and cpm(edges, found, 0.5) > cpm(edges, [{f"{c}{i}" for c in "ab" for i in range(5)}], 0.5)
    with pytest.raises(ValueError):
        community.leiden(blocks, objective="other")


# --- the others -------------------------------------------------------------------


def test_optimal_equals_exhaustive_search(spark):
    for seed in (1,):
        edges = random_edges(seed, 8, 12)
        nodes = sorted({x for e in edges for x in e[:2]})
        best = max(modularity(edges, p) for p in partitions(nodes))
        assert modularity(edges, [sorted(g) for g in groups(optimal.optimal(network(spark, edges)))]) == pytest.approx(best)
    with pytest.raises(RuntimeError):
        optimal.optimal(network(spark, random_edges(1, 14, 40)), most_rows=10, start=network(spark, random_edges(1, 14, 40)).nodes.selectExpr("node", "node as community"))


@pytest.mark.parametrize("k", [2, 4])
def test_fluid_has_k_communities(spark, k):
    edges = [*two_blocks(5), ("x", "y")]
    found = groups(fluid.fluid(network(spark, edges), k))
    assert len(found) == k and set().union(*found) == {f"{c}{i}" for c in "ab" for i in range(5)}
    with pytest.raises(ValueError):
        fluid.fluid(network(spark, edges), 11)


def test_spinglass(spark):
    edges = random_edges(4, 10, 18)
    net = network(spark, edges)
    color = {r.node: r.color for r in spinglass.coloring(net).collect()}
    assert all(color[a] != color[b] for a, b, _ in edges) and len(color) == len({x for e in edges for x in e[:2]})
    found = spinglass.spinglass(net, spins=4, cool_fact=0.3)
    alone = net.nodes.selectExpr("node", "node as community")
    low, high = spinglass.energy(net, found).first().energy, spinglass.energy(net, alone).first().energy
    m = sum(e[2] for e in edges)
    assert low < high == pytest.approx(0.0)
    # the energy is modularity, up to scale and the part of each node with itself
    k = {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    q = modularity(edges, [sorted(g) for g in groups(found)])
    assert low / (m / (m / len(edges))) == pytest.approx(-(q + sum((x / (2 * m)) ** 2 for x in k.values())), abs=1e-9)
    signed = [(a, b, 1.0) for a, b in itertools.combinations(["a0", "a1", "a2", "a3"], 2)] + [(a, b, 1.0) for a, b in itertools.combinations(["b0", "b1", "b2", "b3"], 2)] + [(f"a{i}", f"b{j}", -1.0) for i in range(4) for j in range(4) if i != j]
    got = groups(spinglass.spinglass(network(spark, signed), spins=3, cool_fact=0.4, implementation="neg"))
    assert got == {frozenset(f"{c}{i}" for i in range(4)) for c in "ab"}
