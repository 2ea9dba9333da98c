"""Communities by joins and grouped maxima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from .spectral import settled


def _ties(net: Network, weighted: bool) -> DataFrame:
    """(src, dst, w) of the symmetric matrix; a loop stands once with twice its weight."""
    w = F.col("weight") if weighted else F.lit(1.0)
    e = net.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("w"))
    both = e.filter("a <> b")
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(both.select("b", "a", "w")).union(e.filter("a = b").select("a", "b", 2 * F.col("w")))


def label_propagation(net: Network, weighted: bool = True, mode: str = "out", initial: DataFrame | None = None, fixed: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """(node, community): every node takes the heaviest label around it, its own among equal ones, then the least.

    mode, for directed networks: labels go along the edges (out), against them (in) or
    both ways (all). initial: (node, community) to begin with, null for none yet (without
    it, and where it has no row, every node has its own name); fixed: (node) of nodes that
    keep theirs. What no label reaches keeps its own name. Nodes take turns in random
    halves until none would change; raises if that does not happen.
    """
    if mode not in ("out", "in", "all"):
        raise ValueError("a mode is out, in or all")
    if net.directed and mode != "all":
        to, from_ = ("dst", "src") if mode == "out" else ("src", "dst")
        w = F.sum("weight") if weighted else F.count("*").cast("double")
        ties = net.edges.filter("src <> dst").groupBy(F.col(to).alias("src"), F.col(from_).alias("dst")).agg(w.alias("w"))
    else:
        ties = _ties(net, weighted).filter("src <> dst")
    ties = cut(ties)
    labels = net.nodes.select("node", F.col("node").alias("community"))
    if initial is not None:
        given = initial.select("node", F.col("community").alias("__given"), F.lit(True).alias("__told"))
        labels = net.nodes.select("node").join(given, "node", "left").select("node", F.when(F.col("__told"), F.col("__given")).otherwise(F.col("node")).alias("community"))
    held = F.lit(False)
    if fixed is not None:
        labels, held = labels.join(fixed.select("node", F.lit(True).alias("__held")), "node", "left").select("node", "community", F.coalesce("__held", F.lit(False)).alias("held")), F.col("held")
    else:
        labels = labels.withColumn("held", held)
    labels = cut(labels)
    for i in range(most_rounds):
        own = labels.select(F.col("node").alias("src"), F.col("community").alias("own"))
        told = labels.filter("community is not null").select(F.col("node").alias("dst"), "community")
        heard = ties.join(told, "dst").groupBy("src", "community").agg(F.round(F.sum("w"), 9).alias("w")).join(own, "src")
        best = heard.groupBy("src").agg(F.min_by("community", F.struct(-F.col("w"), ~F.col("community").eqNullSafe(F.col("own")), F.col("community"))).alias("new")).withColumnRenamed("src", "n")
        wants = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("community")) & ~F.col("held")
        turn = F.pmod(F.xxhash64("node", F.lit(i // 2)), F.lit(2)) == i % 2
        labels = cut(labels.join(best, F.col("node") == F.col("n"), "left").select("node", F.when(turn & wants, F.col("new")).otherwise(F.col("community")).alias("community"), "held", wants.alias("wants")), labels)
        if labels.filter("wants").isEmpty():
            return labels.select("node", F.coalesce("community", "node").alias("community"))
    raise RuntimeError("labels did not settle")


def _local_moves(ties: DataFrame, resolution: float, start: DataFrame | None = None, within: DataFrame | None = None, most_rounds: int = 400, mass: DataFrame | None = None) -> DataFrame:
    """(node, c) after moving nodes to the neighbouring community of the largest gain until none would move.

    Nodes take turns in random halves, later in smaller parts, so that they do not
    move past each other for ever. start: (node, c) to begin with, else each alone;
    within: (node, g), moves only into communities of the same g. What a tie must
    outweigh is resolution times the product of masses: (src, k), or else degrees, over
    their sum (modularity).
    """
    k = cut(ties.groupBy("src").agg(F.sum("w").alias("k"))) if mass is None else mass
    m2 = (k.agg(F.sum("k")).first()[0] or 1.0) if mass is None else 1.0
    near = ties.filter("src <> dst")
    if within is not None:
        a, b = within.select(F.col("node").alias("src"), F.col("g").alias("gs")), within.select(F.col("node").alias("dst"), F.col("g").alias("gd"))
        near = cut(near.join(a, "src").join(b, "dst").filter("gs = gd").select("src", "dst", "w"))
    own = k.select(F.col("src").alias("node"), F.col("src").alias("c"), "k") if start is None else k.select(F.col("src").alias("node"), "k").join(start, "node").select("node", "c", "k")
    own = cut(own)
    for i in range(most_rounds):
        total = own.groupBy("c").agg(F.sum("k").alias("tot"))
        found = near.join(own.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst").groupBy("src", "to").agg(F.sum("w").alias("w"))
        stay = own.select(F.col("node").alias("src"), F.col("c").alias("to"), F.lit(0.0).alias("w"))
        offers = found.union(stay).groupBy("src", "to").agg(F.sum("w").alias("w")).join(own.select(F.col("node").alias("src"), "c", "k"), "src").join(total.withColumnRenamed("c", "to"), "to")
        rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / m2, 9)
        best = offers.groupBy(F.col("src").alias("node")).agg(F.min_by("to", F.struct(-gain, F.col("to") != F.col("c"), F.col("to"))).alias("new"))
        parts = 2 + i // 12
        turn = F.pmod(F.xxhash64("node", F.lit(i // parts)), F.lit(parts)) == i % parts
        wants = F.col("new") != F.col("c")
        own = cut(own.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("c")).alias("c"), "k", wants.alias("wants")), own)
        if own.filter("wants").isEmpty():
            return own.select("node", "c")
    raise RuntimeError("moves did not settle")


def _refined(ties: DataFrame, resolution: float, within: DataFrame, mass: DataFrame, scale: float, beta: float, seed: int, rounds: int = 4) -> DataFrame:
    """(node, c): parts of the communities `within` (node, g), merged at random from single nodes.

    A node that is well tied to its community joins a part that is so too, with a chance
    that grows with exp(gain / beta), among those that it does not lose by. Each node has
    one turn; who is alone and on turn moves, the others stand still meanwhile.
    """
    g = within.select("node", "g")
    near = cut(ties.filter("src <> dst").join(g.withColumnRenamed("node", "src"), "src").join(g.select(F.col("node").alias("dst"), F.col("g").alias("gd")), "dst").filter("g = gd").select("src", "dst", "w"))
    own = cut(mass.select(F.col("src").alias("node"), "k").join(g, "node").withColumn("c", F.col("node")))
    whole = cut(own.groupBy("g").agg(F.sum("k").alias("all")))
    share = resolution / scale
    for i in range(rounds):
        placed = near.join(own.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(own.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst")
        ends = placed.filter("cs <> to").groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("cutw"))
        parts = own.groupBy("c", "g").agg(F.sum("k").alias("tot"), F.count("*").alias("n")).join(ends, "c", "left").fillna(0.0, ["cutw"]).join(whole, "g")
        parts = parts.withColumn("well", F.col("cutw") >= share * F.col("tot") * (F.col("all") - F.col("tot")) - 1e-9)
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(rounds)) == i  # noqa: B023, E731
        movers = own.filter(turn("node")).join(parts.filter("n = 1 and well").select("c"), "c").select(F.col("node").alias("src"), "k")
        goals = parts.filter(F.col("well") & ((F.col("n") > 1) | ~turn("c"))).select(F.col("c").alias("to"), "tot")
        offers = placed.groupBy("src", "to").agg(F.sum("w").alias("w")).join(movers, "src").join(goals, "to").withColumn("gain", F.col("w") - share * F.col("k") * F.col("tot")).filter("gain >= -1e-9")
        stays = movers.select(F.col("src").alias("to"), "src", F.lit(0.0).alias("gain"))
        u = (F.shiftrightunsigned(F.xxhash64("src", "to", F.lit(seed + i)), 12).cast("double") + 0.5) / float(1 << 52)
        drawn = offers.select("to", "src", "gain").union(stays).withColumn("luck", F.col("gain") / beta - F.ln(-F.ln(u)))
        new = drawn.groupBy(F.col("src").alias("node")).agg(F.max_by("to", F.struct("luck", "to")).alias("new"))
        own = cut(own.join(new, "node", "left").select("node", "k", "g", F.coalesce("new", "c").alias("c")), own)
    return own.select("node", "c")


def _between(ties: DataFrame, of: DataFrame) -> DataFrame:
    """Ties of the network whose nodes are the communities (node, c)."""
    a, b = of.select(F.col("node").alias("src"), F.col("c").alias("ca")), of.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
    return ties.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w"))


def _named(member: DataFrame) -> DataFrame:
    least = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(least, "community").select("node", F.col("name").alias("community"))


def louvain(net: Network, weighted: bool = True, resolution: float = 1.0, most_levels: int = 100) -> DataFrame:
    """(node, community): local moves, then the communities become nodes, until nothing moves."""
    ties = cut(_ties(net, weighted))
    member = cut(net.nodes.select("node", F.col("node").alias("community")))
    for _ in range(most_levels):
        moved = cut(_local_moves(ties, resolution))
        if moved.filter("node <> c").isEmpty():
            return _named(member)
        member = cut(member.join(moved.withColumnRenamed("node", "community"), "community", "left").select("node", F.coalesce("c", "community").alias("community")), member)
        ties = cut(_between(ties, moved), ties)
    raise RuntimeError("levels did not end")


def leiden(net: Network, weighted: bool = True, resolution: float = 1.0, objective: str = "CPM", beta: float = 0.01, initial: DataFrame | None = None, n_iterations: int = 2, vertex_weights: DataFrame | None = None, seed: int = 1, most_levels: int = 100) -> DataFrame:
    """(node, community): as louvain, but each community is refined before its parts become nodes.

    Refining starts from single nodes and merges at random within the community only, so
    a part is connected and can leave its community at the next level. objective: CPM (a
    tie must outweigh resolution times the product of its ends' weights, which are 1 or
    those of vertex_weights (node, weight)) or modularity. initial: (node, community) to
    begin with; n_iterations: how often all is run, each from what the one before found;
    below 0 until nothing changes.
    """
    if objective not in ("CPM", "modularity"):
        raise ValueError("the objective is CPM or modularity")
    ties = cut(_ties(net, weighted))
    if objective == "CPM":
        own = net.nodes.select("node") if vertex_weights is None else net.nodes.select("node").join(vertex_weights.select("node", F.col("weight").cast("double").alias("k")), "node", "left")
        mass = own.select(F.col("node").alias("src"), F.lit(1.0).alias("k") if vertex_weights is None else F.coalesce("k", F.lit(1.0)).alias("k"))
        scale = 1.0
    else:
        mass = net.nodes.select(F.col("node").alias("src")).join(ties.groupBy("src").agg(F.sum("w").alias("k")), "src", "left").fillna(0.0, ["k"])
        scale = ties.agg(F.sum("w")).first()[0] or 1.0
    mass = cut(mass)
    member = net.nodes.select("node", F.col("node").alias("community"))
    if initial is not None:
        member = net.nodes.select("node").join(initial.select("node", F.col("community").cast("string").alias("__g")), "node", "left").withColumn("__g", F.coalesce("__g", F.col("node").cast("string")))
        member = member.join(member.groupBy("__g").agg(F.min("node").alias("community")), "__g").select("node", "community")
    member, turn = cut(member), 0
    while n_iterations < 0 or turn < n_iterations:
        found = cut(_named(_leiden_pass(ties, mass, scale, resolution, beta, member, seed + 1000 * turn, most_levels)))
        same = found.join(member.withColumnRenamed("community", "before"), "node").filter("community <> before").isEmpty()
        member, turn = found, turn + 1
        if same:
            break
    return member


def _leiden_pass(ties: DataFrame, mass: DataFrame, scale: float, resolution: float, beta: float, member: DataFrame, seed: int, most_levels: int) -> DataFrame:
    """(node, community) after levels of moves, refinement and merging of parts, from a membership named by nodes."""
    start, of = member.select("node", F.col("community").alias("c")), cut(member.select("node", F.col("node").alias("part")))
    for level in range(most_levels):
        moved = cut(_local_moves(ties, resolution / scale, start, mass=mass))
        parts = cut(_refined(ties, resolution, moved.withColumnRenamed("c", "g"), mass, scale, beta, seed + level))
        whole = parts.join(moved.select("node", F.col("c").alias("to")), "node")
        of = cut(of.join(whole.select(F.col("node").alias("part"), "c", "to"), "part").select("node", F.col("c").alias("part"), F.col("to").alias("community")), of)
        if parts.filter("node <> c").isEmpty():
            return of.select("node", "community")
        # A community is named by the least of its parts, which are nodes of the next level.
        pairs = whole.select(F.col("c").alias("node"), "to").distinct()
        start = cut(pairs.join(pairs.groupBy("to").agg(F.min("node").alias("c")), "to").select("node", "c"))
        ties = cut(_between(ties, parts))
        mass = cut(mass.join(parts.withColumnRenamed("node", "src"), "src").groupBy("c").agg(F.sum("k").alias("k")).withColumnRenamed("c", "src"))
        of = of.select("node", "part")
    raise RuntimeError("levels did not end")


def fast_greedy(net: Network, weighted: bool = True) -> DataFrame:
    """(node, community): merges of the pair of communities of the largest gain in modularity while there is one."""
    ties = cut(_ties(net, weighted))
    m2 = ties.agg(F.sum("w")).first()[0] or 1.0
    member = cut(net.nodes.select("node", F.col("node").alias("community")))
    while True:
        own = member.select(F.col("node"), "community")
        placed = ties.join(own.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
        total = placed.groupBy("a").agg(F.sum("w").alias("t"))
        pairs = placed.filter("a < b").groupBy("a", "b").agg(F.sum("w").alias("w")).join(total.withColumnRenamed("t", "ta"), "a").join(total.select(F.col("a").alias("b"), F.col("t").alias("tb")), "b")
        best = pairs.withColumn("gain", F.round(2 * F.col("w") / m2 - 2 * F.col("ta") * F.col("tb") / (m2 * m2), 12)).orderBy(F.desc("gain"), "a", "b").first()
        if best is None or best.gain <= 0:
            return member
        member = cut(member.withColumn("community", F.when(F.col("community") == best.b, F.lit(best.a)).otherwise(F.col("community"))))


def edge_removal(net: Network) -> DataFrame:
    """(node, community) of the best split of Girvan and Newman: edges of the highest betweenness go one by one, until none is left."""
    from .cluster import modularity
    from .paths import edge_betweenness
    from .structure import components

    best, score, left = None, float("-inf"), net.with_edges(net.edges, True)
    flat = Network(net.nodes, net.edges, net.directed)
    while True:
        member = cut(components(left)).withColumnRenamed("component", "community")
        q = modularity(flat, member.withColumnRenamed("community", "cluster")).first()[0] or 0.0
        if q > score + 1e-12:
            best, score = member, q
        if left.edges.isEmpty():
            break
        top = edge_betweenness(left).orderBy(F.desc(F.round("betweenness", 9)), "src", "dst").first()
        if top is None:
            break
        a, b = F.col("src"), F.col("dst")
        gone = (a == top.src) & (b == top.dst) if net.directed else (F.least(a, b) == top.src) & (F.greatest(a, b) == top.dst)
        left = Network(net.nodes, cut(left.edges.filter(~gone)), net.directed)
    return best


def leading_eigenvector(net: Network, weighted: bool = True, most_splits: int = 100) -> DataFrame:
    """(node, community): communities are bisected by the sign of the leading eigenvector of their modularity matrix, all at once, while modularity rises."""
    ties = cut(_ties(net, weighted))
    k = net.nodes.select("node").join(ties.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "node", "left").fillna(0.0, ["k"])
    member = cut(k.join(F.broadcast(k.agg(F.min("node").alias("c"))), how="cross").withColumn("open", F.lit(True)))
    m2 = member.agg(F.sum("k")).first()[0] or 1.0
    for _ in range(most_splits):
        a, b = member.filter("open").select(F.col("node").alias("src"), F.col("c").alias("ca")), member.filter("open").select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        inner = cut(ties.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", "w"))
        inside = inner.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("ki"))
        total = member.filter("open").groupBy("c").agg(F.sum("k").alias("kc"))
        base = member.filter("open").join(inside, "node", "left").join(total, "c").select("node", "c", "k", "kc", (F.coalesce("ki", F.lit(0.0)) - F.col("k") * F.col("kc") / m2).alias("d"))
        # Rows of the matrix sum to nothing within a community; a shift makes the leading eigenvalue the largest one.
        base = cut(base)
        widest = (base.agg(F.max(F.col("k") + F.abs("d"))).first()[0] or 0.0) + 1e-9


        def matrix(shift: float, base=base, inner=inner) -> DataFrame:
            """The shifted matrix of all communities as cells (src, dst, w, c). What a community takes off each node, its mean by degree, is an entry of the vector too, so a step is one join and one sum."""
            one, whole = [lambda c, mean=mean: F.struct(F.col(c).alias("node"), F.lit(mean).alias("mean")) for mean in (False, True)]
            own = shift - F.col("d")
            into = inner.join(base.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("ks") * F.col("w")).alias("q"))
            cells = [
                inner.join(base.select(F.col("node").alias("src"), "c"), "src").select(one("src").alias("src"), one("dst").alias("dst"), "w", "c"),
                base.select(one("node"), one("node"), own, "c"),
                base.select(one("node"), whole("c"), -F.col("k") * F.col("kc") / m2, "c"),
                base.join(into, "node", "left").select(whole("c"), one("node"), F.try_divide(F.coalesce("q", F.lit(0.0)) + own * F.col("k"), F.col("kc")), "c"),
                base.groupBy("c").agg((-F.sum(F.col("k") * F.col("k")) / m2).alias("w")).select(whole("c"), whole("c"), "w", "c"),
            ]
            return cut(reduce(DataFrame.union, cells))

        def steps(x: DataFrame, cells: DataFrame, times: int) -> DataFrame:
            for _ in range(times):
                x = cells.join(x.select(F.col("node").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.coalesce(F.sum(F.col("w") * F.col("x")), F.lit(0.0)).alias("x"))
            return x

        def onward(x: DataFrame, cells: DataFrame) -> DataFrame:
            """Eight steps; then the largest value of each community is 1."""
            y = cut(steps(x, cells, 8))
            top = y.filter("not node.mean").groupBy("c").agg(F.max(F.abs("x")).alias("top"))
            return y.join(top, "c").select("node", "c", F.coalesce(F.try_divide("x", "top"), F.lit(0.0)).alias("x"))

        entry = lambda c, mean, x: base.select(F.struct(F.col(c).alias("node"), F.lit(mean).alias("mean")).alias("node"), "c", x.alias("x"))  # noqa: B023, E731
        seed = entry("node", False, F.pmod(F.xxhash64("node"), F.lit(1000)) / 1000.0 - 0.5).union(entry("c", True, F.lit(0.0)).distinct())
        for share in (0.3, 2.0):  # a small shift settles soon; where it finds the other end of the spectrum, a sure one
            cells = matrix(share * widest)
            x = settled(seed, lambda x, cells=cells: onward(x, cells), False, every=1, tolerance=5e-3, most=250)
            after = steps(x, matrix(0.0), 1).select("node", F.col("x").alias("y")).join(x, "node").filter("not node.mean").agg(F.sum(F.col("x") * F.col("y")).alias("s")).first()
            if (after.s or 0.0) > 0:
                break
        side = cut(base.join(x.filter("not node.mean").select("node.node", "x"), "node").select("node", "c", "k", "d", (F.col("x") >= 0).alias("side")))
        # The gain of a split: s'Bs over twice the weight, s being 1 and -1.
        s = F.when(F.col("side"), 1.0).otherwise(-1.0)
        sign = side.select("node", s.alias("s"))
        pair = inner.join(sign.select(F.col("node").alias("src"), F.col("s").alias("sa")), "src").join(sign.select(F.col("node").alias("dst"), F.col("s").alias("sb")), "dst").join(side.select(F.col("node").alias("src"), "c"), "src").groupBy("c").agg(F.sum(F.col("w") * F.col("sa") * F.col("sb")).alias("q"))
        sums = side.groupBy("c").agg(F.sum(F.col("k") * s).alias("ks"), F.sum("d").alias("d"), F.countDistinct("side").alias("n"))
        gain = sums.join(pair, "c", "left").select("c", ((F.col("n") == 2) & (F.coalesce("q", F.lit(0.0)) - F.col("ks") * F.col("ks") / m2 - F.col("d") > 1e-9)).alias("split"))
        placed = side.join(gain, "c").select("node", "k", "c", "side", "split")
        named = placed.withColumn("new", F.min("node").over(Window.partitionBy("c", "side")))
        now = named.select("node", "k", F.when(F.col("split"), F.col("new")).otherwise(F.col("c")).alias("c"), F.col("split").alias("open"))
        member = cut(member.filter("not open").select("node", "k", "c", "open").unionByName(now))
        if member.filter("open").isEmpty():
            return member.select("node", F.col("c").alias("community"))
    raise RuntimeError("splits did not end")


def communities(net: Network, method: str = "louvain", **options) -> DataFrame:
    """(node, community) by the method of this name, with its own options; fluid needs k."""
    from . import fluid, infomap, optimal, spinglass, walktrap

    methods = {
        "louvain": louvain, "leiden": leiden, "fast_greedy": fast_greedy, "walktrap": walktrap.walktrap, "infomap": infomap.infomap, "label_propagation": label_propagation,
        "edge_betweenness": edge_removal, "leading_eigenvector": leading_eigenvector, "spinglass": spinglass.spinglass, "optimal": optimal.optimal, "fluid": fluid.fluid,
    }
    if method not in methods:
        raise ValueError(f"a method is one of {', '.join(methods)}")
    return methods[method](net, **options)


def sizes(member: DataFrame) -> DataFrame:
    return member.groupBy("community").agg(F.count("*").alias("nodes"))
