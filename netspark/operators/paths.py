"""Shortest paths from all (or some) sources, and the measures that read them.

Distances grow by frontiers: each pass joins the entries that improved last with
the arcs and keeps the least distance a (source, node). Path counts follow the
tight arcs level by level, and dependencies go back the same way. State is a
table of (source, node) pairs spread by source, so passes scale out with the
number of sources; restrict `sources` on large networks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut

#: Sources of which paths are held at once.
BATCH = 2000


def distance_arcs(net: Network, weighted: bool = False, invert: bool = False, alpha: float = 1.0) -> DataFrame:
    """(u, v, w): the shortest arc between two nodes; with `invert`, heavy edges are short."""
    w = (1 / F.pow(F.col("weight"), alpha) if invert else F.col("weight")) if weighted else F.lit(1.0)
    return net.arcs().filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), w.cast("double").alias("w")).groupBy("u", "v").agg(F.min("w").alias("w"))


def distances(net: Network, weighted: bool = False, invert: bool = False, alpha: float = 1.0, cutoff: float | None = None, sources: DataFrame | None = None, most_passes: int = 10_000, arcs: DataFrame | None = None) -> DataFrame:
    """(source, node, dist) for every node that a source reaches, itself at 0; arcs: those of `distance_arcs`, where they are stored already."""
    arcs = arcs or cut(distance_arcs(net, weighted, invert, alpha))
    front = (sources or net.nodes).select(F.col("node").alias("source"), F.col("node"), F.lit(0.0).alias("dist"))
    known = front = cut(front)
    for _ in range(most_passes):
        step = front.join(arcs, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("near"))
        if cutoff is not None:
            step = step.filter(F.col("near") <= cutoff)
        step = step.groupBy("source", "node").agg(F.min("near").alias("near"))
        merged = cut(known.join(step, ["source", "node"], "full_outer").select("source", "node", F.least("dist", "near").alias("dist"), (F.col("near").isNotNull() & (F.col("dist").isNull() | (F.col("near") < F.col("dist") - 1e-12))).alias("new")))
        known, front = merged.select("source", "node", "dist"), merged.filter("new").select("source", "node", "dist")
        if front.isEmpty():
            return known
    raise RuntimeError(f"distances still fall after {most_passes} passes")


def _pairs(dist: DataFrame) -> DataFrame:
    return dist.filter("source <> node")


def _per_node(net: Network, found: DataFrame, name: str, none: float) -> DataFrame:
    return net.nodes.select("node").join(found, "node", "left").select("node", F.coalesce(name, F.lit(none)).cast("double").alias(name))


def _from_sources(net: Network, mode: str, weighted: bool, invert: bool, alpha: float, cutoff: float | None, batch: int | None, told: list[Column], own: bool = False) -> DataFrame:
    """(node, ..): aggregates over the distances from each source, batch by batch; own: its distance to itself counts."""
    facing, each = _facing(net, mode), []
    arcs = cut(distance_arcs(facing, weighted, invert, alpha))
    for part in _batches(facing, None, batch):
        d = distances(facing, cutoff=cutoff, sources=part, arcs=arcs)
        each.append(cut((d if own else _pairs(d)).groupBy(F.col("source").alias("node")).agg(*told)))
    made = each[0]
    for more in each[1:]:
        made = made.union(more)
    return made


def _facing(net: Network, mode: str) -> Network:
    """The network whose out-distances are the distances of the mode."""
    from ..network import undirected

    if not net.directed or mode == "out":
        return net
    if mode == "all":
        return undirected(net)
    return Network(net.nodes, net.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), True)


def closeness(net: Network, mode: str = "all", normalized: bool = False, weighted: bool = False, cutoff: float | None = None, invert: bool = False, alpha: float = 1.0, batch: int | None = BATCH) -> DataFrame:
    """1 / sum of distances to what is reached (times how many, if normalized); NaN where nothing is."""
    top = F.count("*") if normalized else F.lit(1)
    return _per_node(net, _from_sources(net, mode, weighted, invert, alpha, cutoff, batch, [(top / F.sum("dist")).alias("closeness")]), "closeness", float("nan"))


def harmonic(net: Network, mode: str = "all", weighted: bool = False, cutoff: float | None = None, invert: bool = False, alpha: float = 1.0, batch: int | None = BATCH) -> DataFrame:
    """Sum of 1 / distance."""
    return _per_node(net, _from_sources(net, mode, weighted, invert, alpha, cutoff, batch, [F.sum(1 / F.col("dist")).alias("harmonic")]), "harmonic", 0.0)


def eccentricity(net: Network, mode: str = "all", weighted: bool = False, cutoff: float | None = None, invert: bool = False, alpha: float = 1.0, batch: int | None = BATCH) -> DataFrame:
    """Largest distance to a reached node."""
    return _per_node(net, _from_sources(net, mode, weighted, invert, alpha, cutoff, batch, [F.max("dist").alias("eccentricity")], own=True), "eccentricity", 0.0)


def kreach(net: Network, k: float = 3, mode: str = "all", weighted: bool = False, batch: int | None = BATCH) -> DataFrame:
    """Other nodes within distance k."""
    return _per_node(net, _from_sources(net, mode, weighted, False, 1.0, k, batch, [F.count("*").alias("kreach")]), "kreach", 0.0)


def path_summary(net: Network, weighted: bool = False, batch: int | None = BATCH) -> DataFrame:
    """One row: radius, diameter, mean_distance, global_efficiency."""
    far = F.col("source") != F.col("node")
    told = [F.max("dist").alias("e"), F.count(F.when(far, 1)).alias("m"), F.sum(F.when(far, F.col("dist"))).alias("s"), F.sum(F.when(far, 1 / F.col("dist"))).alias("i")]
    each = _from_sources(net, "out", weighted, False, 1.0, None, batch, told, own=True)
    n = F.count("*")
    return each.agg(F.min("e").alias("radius"), F.max("e").alias("diameter"), F.try_divide(F.sum("s"), F.sum("m")).alias("mean_distance"), F.try_divide(F.coalesce(F.sum("i"), F.lit(0.0)), n * (n - 1)).alias("global_efficiency"))


def _counted(net: Network, weighted: bool, invert: bool, sources: DataFrame | None = None, cutoff: float | None = None, alpha: float = 1.0) -> tuple[DataFrame, DataFrame, int]:
    """Tight arcs (source, u, v), nodes (source, node, dist, sigma, level), and the number of levels.

    The level is the largest number of arcs on a shortest path, so that all
    predecessors of a node lie on lower levels.
    """
    arcs = cut(distance_arcs(net, weighted, invert, alpha))
    d = distances(net, cutoff=cutoff, sources=sources, arcs=arcs)
    du, dv = d.select("source", F.col("node").alias("u"), F.col("dist").alias("du")), d.select("source", F.col("node").alias("v"), F.col("dist").alias("dv"))
    tight = cut(du.join(arcs, "u").join(dv, ["source", "v"]).filter(F.abs(F.col("du") + F.col("w") - F.col("dv")) <= 1e-9 * F.greatest(F.lit(1.0), "dv")).select("source", "u", "v"))
    front = cut(d.filter("source = node").select("source", "node"))
    levels, level = front.withColumn("level", F.lit(0)), 0
    if weighted:
        while True:
            level += 1
            front = cut(front.join(tight.withColumnRenamed("u", "node"), ["source", "node"]).select("source", F.col("v").alias("node")).distinct())
            if front.isEmpty():
                break
            levels = levels.union(front.withColumn("level", F.lit(level)))
        levels = levels.groupBy("source", "node").agg(F.max("level").alias("level"))
    else:
        levels = d.select("source", "node", F.col("dist").cast("int").alias("level"))
    levels = cut(levels)
    depth = levels.agg(F.max("level")).first()[0] or 0
    to = levels.select("source", F.col("node").alias("v"), "level")
    placed = cut(tight.join(to, ["source", "v"]))
    sigma = levels.filter("level = 0").select("source", "node", F.lit(1.0).alias("sigma"))
    for i in range(1, depth + 1):
        more = placed.filter(F.col("level") == i).join(sigma.withColumnRenamed("node", "u"), ["source", "u"]).groupBy("source", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
        sigma = cut(sigma.union(more))
    return placed, cut(levels.join(sigma, ["source", "node"]).join(d, ["source", "node"])), depth


def _batches(net: Network, sources: DataFrame | None, batch: int | None) -> list[DataFrame]:
    """The sources in parts of about `batch`, by hash; one part where they are no more (or batch is None)."""
    chosen = (sources or net.nodes).select("node")
    parts = 1 if batch is None else max(1, -(-chosen.count() // batch))
    return [chosen] if parts == 1 else [chosen.filter(F.pmod(F.xxhash64("node"), F.lit(parts)) == i) for i in range(parts)]


def _summed(tables: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The sum of a column over tables of batches, each stored before the next batch begins."""
    made = tables[0]
    for more in tables[1:]:
        made = made.union(more)
    return made.groupBy(*keys).agg(F.sum(value).alias(value))


def _dependencies(net: Network, weighted: bool, invert: bool, share: str, sources: DataFrame | None = None, cutoff: float | None = None, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Per (source, node) dependency, and per (source, u, v) what flows over the arc.

    share 'paths' splits by path counts (betweenness); 'equal' splits what a node
    holds, itself included, evenly over its predecessors (load).
    """
    placed, nodes, depth = _counted(net, weighted, invert, sources, cutoff, alpha)
    sigma = nodes.select("source", F.col("node").alias("u"), F.col("sigma").alias("su"))
    below = nodes.select("source", F.col("node").alias("v"), F.col("sigma").alias("sv"))
    arcs = placed.join(sigma, ["source", "u"]).join(below, ["source", "v"])
    if share == "equal":
        arcs = arcs.join(placed.groupBy("source", "v").agg(F.count("*").alias("n")), ["source", "v"])
    arcs = cut(arcs)
    flow = None
    for i in range(depth, 0, -1):
        now = arcs.filter(F.col("level") == i)
        if flow is None:
            held = now.withColumn("held", F.lit(0.0))
        else:
            got = flow.groupBy("source", F.col("u").alias("v")).agg(F.sum("flow").alias("held"))
            held = now.join(got, ["source", "v"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
        part = F.col("su") / F.col("sv") if share == "paths" else 1 / F.col("n")
        sent = held.select("source", "u", "v", (part * (1 + F.col("held"))).alias("flow"))
        flow = cut(sent if flow is None else flow.union(sent))
    if flow is None:
        flow = arcs.select("source", "u", "v", F.lit(0.0).alias("flow"))
    dep = flow.groupBy("source", F.col("u").alias("node")).agg(F.sum("flow").alias("dependency"))
    return dep, flow


def betweenness(net: Network, weighted: bool = False, invert: bool = False, sources: DataFrame | None = None, cutoff: float | None = None, alpha: float = 1.0, batch: int | None = BATCH) -> DataFrame:
    """Shortest paths through each node (fractions of each pair's), none longer than the cutoff; unordered pairs once if undirected.

    Sources run `batch` at a time and leave a row a node, so the state is batch times nodes.
    """
    each = []
    for part in _batches(net, sources, batch):
        dep, _ = _dependencies(net, weighted, invert, "paths", part, cutoff, alpha)
        each.append(cut(dep.filter("source <> node").groupBy("node").agg((F.sum("dependency") / (1 if net.directed else 2)).alias("betweenness"))))
    return _per_node(net, _summed(each, ["node"], "betweenness"), "betweenness", 0.0)


def edge_betweenness(net: Network, weighted: bool = False, invert: bool = False, cutoff: float | None = None, alpha: float = 1.0, batch: int | None = BATCH) -> DataFrame:
    """(src, dst, betweenness) of the simple edges, paths longer than the cutoff left out; undirected ones by least and greatest end."""
    ends = (F.col("u"), F.col("v")) if net.directed else (F.least("u", "v"), F.greatest("u", "v"))
    each = []
    for part in _batches(net, None, batch):
        _, flow = _dependencies(net, weighted, invert, "paths", part, cutoff, alpha)
        each.append(cut(flow.groupBy(ends[0].alias("src"), ends[1].alias("dst")).agg((F.sum("flow") / (1 if net.directed else 2)).alias("betweenness"))))
    return _summed(each, ["src", "dst"], "betweenness")


def load(net: Network, weighted: bool = False, batch: int | None = BATCH) -> DataFrame:
    """What passes each node if every node sends one unit to every source, split evenly over predecessors.

    Each (source, node) pair holds one unit from the start, reached or not.
    """
    each = []
    for part in _batches(net, None, batch):
        dep, _ = _dependencies(net, weighted, False, "equal", part)
        each.append(cut(dep.groupBy("node").agg(F.sum("dependency").alias("load"))))
    n = net.nodes.agg(F.count("*").alias("n"))
    return _per_node(net, _summed(each, ["node"], "load"), "load", 0.0).join(n, how="cross").select("node", (F.col("load") + F.col("n")).alias("load"))


def percolation(net: Network, states: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """Betweenness with each source weighed by its share of the others' states; states (node, state), missing 1."""
    state = net.nodes.select("node")
    state = state.withColumn("state", F.lit(1.0)) if states is None else state.join(states, "node", "left").select("node", F.least(F.greatest(F.coalesce("state", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("state"))
    total = state.agg(F.sum("state").alias("total"), F.count("*").alias("n"))
    dep, _ = _dependencies(net, weighted, False, "paths")
    own, from_ = state.withColumnRenamed("state", "own"), state.select(F.col("node").alias("source"), "state")
    each = dep.filter("source <> node").join(own, "node").join(from_, "source").join(total, how="cross")
    found = each.groupBy("node").agg(F.sum(F.col("dependency") * F.try_divide("state", F.col("total") - F.col("own")) / (F.col("n") - 2)).alias("percolation"))
    return _per_node(net, found, "percolation", 0.0)


def girth(net: Network) -> DataFrame:
    """Length of the shortest cycle of the simple undirected network; infinity without any.

    From each source, an edge between two nodes that is not on the tree of one
    predecessor a node closes a walk of length d(u) + d(v) + 1; the least over
    all sources is the girth.
    """
    s = net.simple()
    flat = Network(net.nodes, s.withColumn("weight", F.lit(1.0)), False)
    d = cut(distances(flat))
    du, dv = d.select("source", F.col("node").alias("src"), F.col("dist").alias("du")), d.select("source", F.col("node").alias("dst"), F.col("dist").alias("dv"))
    ends = s.join(du, "src").join(dv, ["source", "dst"])
    level = ends.filter("du = dv").select((2 * F.col("du") + 1).alias("c"))
    # Two predecessors of a node close an even cycle.
    up = ends.filter("du <> dv").select("source", F.when(F.col("du") > F.col("dv"), F.col("src")).otherwise(F.col("dst")).alias("low"), F.greatest("du", "dv").alias("g")).groupBy("source", "low", "g").agg(F.count("*").alias("n")).filter("n > 1").select((2 * F.col("g")).alias("c"))
    return level.union(up).agg(F.coalesce(F.min("c"), F.lit(float("inf"))).alias("girth"))


def local_efficiency(net: Network) -> DataFrame:
    """(node, efficiency): mean inverse distance within the network of a node's neighbours; 0 below two.

    All neighbourhoods are one disjoint union, searched together.
    """
    around = net.around()
    inner = around.alias("a").join(net.simple().alias("e"), F.col("a.other") == F.col("e.src")).join(around.alias("b"), (F.col("b.node") == F.col("a.node")) & (F.col("b.other") == F.col("e.dst")))
    key = lambda c: F.struct(F.col("a.node").alias("of"), F.col(c).alias("at"))
    edges = inner.select(key("e.src").alias("src"), key("e.dst").alias("dst"), F.lit(1.0).alias("weight"))
    nodes = around.select(F.struct(F.col("node").alias("of"), F.col("other").alias("at")).alias("node"))
    d = _pairs(distances(Network(nodes, edges, False))).groupBy(F.col("source.of").alias("node")).agg(F.sum(1 / F.col("dist")).alias("s"))
    k = around.groupBy("node").agg(F.count("*").alias("k"))
    return net.nodes.select("node").join(k, "node", "left").join(d, "node", "left").select("node", F.when(F.col("k") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("efficiency"))


def within(net: Network, of: Column | list, order: int = 1) -> DataFrame:
    """Nodes at most so many steps from the chosen ones, either way, themselves included."""
    chosen = net.nodes.filter(of if isinstance(of, Column) else F.col("node").isin(list(of))).select("node")
    for _ in range(order):
        near = chosen.join(net.around(), "node").select(F.col("other").alias("node"))
        chosen = chosen.union(near).distinct()
    return net.nodes.join(chosen, "node", "left_semi")
