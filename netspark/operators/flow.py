"""Current flow: the network as resistors, edge weights as conductances.

Potentials for a unit current from each source (and out at all nodes alike) solve
the Laplacian. Conjugate gradients run for all sources at once: the state is a row
for each (source, node), a step is a join with the arcs and sums by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network, undirected
from ..session import cut, discard
from .structure import components


def _conductances(net: Network, weighted: bool) -> DataFrame:
    """(src, dst, w) in both directions, each pair once, without loops."""
    flat = undirected(Network(net.nodes, net.edges.filter("src <> dst"), net.directed))
    w = F.col("weight") if weighted else F.lit(1.0)
    return flat.arcs().select("src", "dst", w.cast("double").alias("w"))


def potentials(net: Network, weighted: bool = False, tolerance: float = 1e-11, most: int = 2000) -> DataFrame:
    """(source, node, p): the columns of the pseudoinverse of the Laplacian, zero in sum."""
    arcs = cut(_conductances(net, weighted))
    strength = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    nodes = cut(net.nodes.select("node").join(strength, "node", "left").fillna(0.0, ["k"]))
    n = nodes.count()
    grid = nodes.select(F.col("node").alias("source")).join(nodes.select("node"), how="cross")
    r = F.when(F.col("source") == F.col("node"), 1.0).otherwise(0.0) - 1.0 / max(n, 1)
    state = cut(grid.select("source", "node", F.lit(0.0).alias("x"), r.alias("r"), r.alias("p")))
    for _ in range(most):
        near = state.join(arcs, F.col("node") == F.col("dst")).groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("ap"))
        wide = state.join(nodes, "node").join(near, ["source", "node"], "left").withColumn("ap", F.col("k") * F.col("p") - F.coalesce("ap", F.lit(0.0)))
        of = Window.partitionBy("source")  # a source's rows: one for each node
        stepped = wide.withColumn("rr", F.sum(F.col("r") * F.col("r")).over(of)).withColumn("a", F.coalesce(F.try_divide("rr", F.sum(F.col("p") * F.col("ap")).over(of)), F.lit(0.0)))
        moved = stepped.select("source", "node", (F.col("x") + F.col("a") * F.col("p")).alias("x"), (F.col("r") - F.col("a") * F.col("ap")).alias("r"), "p", "rr")
        turned = moved.withColumn("new", F.sum(F.col("r") * F.col("r")).over(of))
        nxt = cut(turned.select("source", "node", "x", "r", (F.col("r") + F.coalesce(F.try_divide("new", "rr"), F.lit(0.0)) * F.col("p")).alias("p")), state)
        state = nxt
        if (state.agg(F.max(F.abs("r"))).first()[0] or 0.0) <= tolerance:
            discard(arcs, nodes)
            return state.select("source", "node", F.col("x").alias("p"))
    raise RuntimeError("potentials did not settle")


def _connected(net: Network) -> bool:
    return components(net).select("component").distinct().limit(2).count() < 2


def current_flow_closeness(net: Network, weighted: bool = False) -> DataFrame:
    """(node, current_flow_closeness): n - 1 over the resistances to all others; null for networks in several parts or of one node."""
    none = net.nodes.select("node", F.lit(None).cast("double").alias("current_flow_closeness"))
    if net.nodes.limit(2).count() < 2 or not _connected(net):
        return none
    own = potentials(net, weighted).filter("source = node").select("node", "p")
    total = own.agg(F.sum("p").alias("t"), F.count("*").alias("n"))
    return own.join(total, how="cross").select("node", ((F.col("n") - 1) / (F.col("n") * F.col("p") + F.col("t"))).alias("current_flow_closeness"))


def current_flow_betweenness(net: Network, weighted: bool = False) -> DataFrame:
    """(node, current_flow_betweenness): the current that passes a node between all pairs of others, over their number.

    An arc's current between two sources is the difference of what either sends
    over it; the sum over all pairs follows from their order.
    """
    if net.nodes.limit(3).count() < 3:
        return net.nodes.select("node", F.lit(0.0).alias("current_flow_betweenness"))
    if not _connected(net):
        return net.nodes.select("node", F.lit(None).cast("double").alias("current_flow_betweenness"))
    p = potentials(net, weighted)
    here, there = p.select("source", F.col("node").alias("src"), F.col("p").alias("ps")), p.select("source", F.col("node").alias("dst"), F.col("p").alias("pd"))
    sent = _conductances(net, weighted).join(here, "src").join(there, ["source", "dst"]).filter("source <> src").select("src", "dst", (F.col("w") * (F.col("ps") - F.col("pd"))).alias("d"))
    arc = Window.partitionBy("src", "dst")
    ranked = sent.withColumn("i", F.row_number().over(arc.orderBy("d"))).withColumn("m", F.count("*").over(arc))
    through = ranked.groupBy(F.col("src").alias("node")).agg((F.sum((2 * F.col("i") - F.col("m") - 1) * F.col("d")) / 2).alias("s"), F.max(F.col("m") + 1).alias("n"))
    return net.nodes.select("node").join(through, "node", "left").select("node", F.coalesce(2 * F.col("s") / ((F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("current_flow_betweenness"))
