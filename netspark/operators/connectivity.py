"""Minimum cuts: how many edges or nodes must go before a network falls apart.

Every pair of ends has a residual network of its own in one table, and all pairs
look for one more path at the same time. The first round in which a pair finds
none gives the least number over all pairs, so there is one round more than the
answer. State is pairs times edges: for networks of hundreds of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut, discard


def _augmented(left: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, path): for each pair whose ends are linked over arcs (pair, u, v, room), the nodes of a shortest path.

    Of several ways to a node, that over the least node before it.
    """
    front = cut(pairs.select("pair", F.col("s").alias("node"), F.array("s").alias("path")))
    known = front.select("pair", "node")
    found = None
    while True:
        step = front.join(left.withColumnRenamed("u", "node"), ["pair", "node"]).groupBy("pair", F.col("v").alias("node")).agg(F.min_by("path", "node").alias("path"))
        step = step.join(known, ["pair", "node"], "left_anti").select("pair", "node", F.concat("path", F.array("node")).alias("path"))
        front = cut(step)
        there = front.join(pairs.select("pair", F.col("t").alias("node")), ["pair", "node"], "left_semi").select("pair", "path")
        found = there if found is None else found.unionByName(there)
        if front.isEmpty():
            return cut(found)
        known = known.unionByName(front.select("pair", "node"))
        front = front.join(found.select("pair"), "pair", "left_anti")


def _least_flow(arcs: DataFrame, pairs: DataFrame, most: int) -> int:
    """The least number, over all pairs (pair, s, t), of paths from s to t that share no arc."""
    pairs = cut(pairs)
    left = cut(pairs.select("pair").join(arcs.withColumn("room", F.lit(1).cast("long")), how="cross"))
    n = pairs.count()
    for done in range(most + 1):
        paths = _augmented(left, pairs)
        if paths.count() < n:
            return done
        used = paths.select("pair", F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("u"), F.expr("slice(path, 2, size(path) - 1)").alias("v"))).alias("arc")).select("pair", "arc.u", "arc.v")
        change = used.select("pair", "u", "v", F.lit(-1).cast("long").alias("room")).unionByName(used.select("pair", F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).cast("long").alias("room")))
        left = cut(left.unionByName(change).groupBy("pair", "u", "v").agg(F.sum("room").alias("room")).filter("room > 0"), left)
        discard(paths)
    raise RuntimeError("more disjoint paths than nodes")


def min_cut(net: Network) -> DataFrame:
    """(min_cut): the least number of edges without which some node cannot be reached from some other (weights and loops do not count); 0 for fewer than two nodes."""
    arcs = net.arcs().filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    names = net.nodes.select("node").distinct()
    first = names.agg(F.min("node").alias("s"))
    pairs = names.join(first, F.col("node") != F.col("s")).select("s", F.col("node").alias("t"))
    if net.directed:
        pairs = pairs.unionByName(pairs.select(F.col("t").alias("s"), F.col("s").alias("t")))
    n = names.count()
    value = _least_flow(arcs, pairs.select(F.struct("s", "t").alias("pair"), "s", "t"), n) if n > 1 else 0
    return net.nodes.sparkSession.range(1).select(F.lit(value).cast("long").alias("min_cut"))


def vertex_connectivity(net: Network) -> DataFrame:
    """(vertex_connectivity): the least number of nodes without which some other cannot be reached; one less than the nodes where every pair is linked.

    Every node is an arc from its way in to its way out, so paths that share no arc share no node.
    """
    arcs = cut(net.arcs().filter("src <> dst").select("src", "dst").distinct())
    names = net.nodes.select("node").distinct()
    apart = names.select(F.col("node").alias("src")).join(names.select(F.col("node").alias("dst")), F.col("src") != F.col("dst") if net.directed else F.col("src") < F.col("dst")).join(arcs, ["src", "dst"], "left_anti")
    n = names.count()
    side = lambda c, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("out"))
    if n < 2 or apart.isEmpty():
        value = max(n - 1, 0)
    else:
        through = names.select(side("node", False).alias("u"), side("node", True).alias("v"))
        split = through.unionByName(arcs.select(side("src", True).alias("u"), side("dst", False).alias("v")))
        value = _least_flow(split, apart.select(F.struct("src", "dst").alias("pair"), side("src", True).alias("s"), side("dst", False).alias("t")), n)
    return net.nodes.sparkSession.range(1).select(F.lit(value).cast("long").alias("vertex_connectivity"))
