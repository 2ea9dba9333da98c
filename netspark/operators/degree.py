"""Degree, strength and what follows from them by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut


def _ends(net: Network, mode: str) -> DataFrame:
    """(node, weight), a row for each end that counts in the mode; undirected edges count at both ends."""
    e = net.edges
    out, into = e.select(F.col("src").alias("node"), "weight"), e.select(F.col("dst").alias("node"), "weight")
    if not net.directed or mode == "all":
        return out.union(into)
    return out if mode == "out" else into


def _spread(net: Network, values: DataFrame, name: str, kind: str) -> DataFrame:
    return net.nodes.select("node").join(values, "node", "left").select("node", F.coalesce(name, F.lit(0)).cast(kind).alias(name))


def degree(net: Network, mode: str = "all", name: str = "degree") -> DataFrame:
    """Edges at each node by mode (in, out, all); a loop counts twice in all."""
    return _spread(net, _ends(net, mode).groupBy("node").agg(F.count("*").alias(name)), name, "long")


def strength(net: Network, mode: str = "all", name: str = "strength") -> DataFrame:
    """Sum of weights at each node by mode."""
    return _spread(net, _ends(net, mode).groupBy("node").agg(F.sum("weight").alias(name)), name, "double")


def _neighbours(net: Network, mode: str) -> DataFrame:
    """(node, other): distinct neighbours by mode; a node with a loop is its own neighbour."""
    arcs = net.arcs()
    out, into = arcs.select(F.col("src").alias("node"), F.col("dst").alias("other")), arcs.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    return {"out": out, "in": into, "all": out.union(into)}[mode].distinct()


def diffusion(net: Network, mode: str = "all", scale: float = 1.0) -> DataFrame:
    """scale times the degrees of a node and of its distinct neighbours."""
    deg = degree(net, mode).withColumn("own", F.lit(scale) * F.col("degree"))
    other = deg.select(F.col("node").alias("other"), F.col("own").alias("theirs"))
    near = _neighbours(net, mode).join(other, "other").groupBy("node").agg(F.sum("theirs").alias("near"))
    return deg.join(near, "node", "left").select("node", (F.col("own") + F.coalesce("near", F.lit(0.0))).alias("diffusion"))


def leverage(net: Network, mode: str = "all") -> DataFrame:
    """Mean over distinct neighbours of (k - k') / (k + k'); NaN where there are none."""
    deg = degree(net, mode)
    other = deg.select(F.col("node").alias("other"), F.col("degree").alias("k"))
    near = _neighbours(net, mode).join(deg, "node").join(other, "other")
    each = F.when(F.col("degree") + F.col("k") == 0, 0.0).otherwise(F.try_divide(F.col("degree") - F.col("k"), F.col("degree") + F.col("k")))
    found = near.groupBy("node").agg(F.avg(each).alias("leverage"))
    return net.nodes.select("node").join(found, "node", "left").select("node", F.coalesce("leverage", F.lit(float("nan"))).alias("leverage"))


def laplacian(net: Network) -> DataFrame:
    """k^2 + k + 2 * the degrees of the (out-)neighbours."""
    deg = degree(net)
    other = deg.select(F.col("node").alias("other"), F.col("degree").alias("k"))
    near = _neighbours(net, "out").filter("node <> other").join(other, "other").groupBy("node").agg(F.sum("k").alias("s"))
    return deg.join(near, "node", "left").select("node", (F.col("degree") * F.col("degree") + F.col("degree") + 2 * F.coalesce("s", F.lit(0))).cast("double").alias("laplacian"))


def voterank(net: Network, top: int | None = None) -> DataFrame:
    """(node, voterank): nodes elected one after the other by the votes of their (in-)neighbours, the first 1, later ones less.

    The elected vote no more, and the votes of their (out-)neighbours lose one over the
    mean degree. Ties go by node. A round is a job; `top` ends the election early
    (others 0), as do votes that have run out: the rest then follow by node.
    """
    arcs = cut(net.arcs().filter("src <> dst").select("src", "dst").distinct())
    state = cut(net.nodes.select("node", F.lit(1.0).alias("power"), F.lit(None).cast("long").alias("rank")))
    n = state.count()
    mean = degree(net).agg(F.avg("degree")).first()[0] or 1.0
    for turn in range(1, n + 1 if top is None else min(n, top) + 1):
        free = state.filter("rank is null")
        votes = arcs.join(free.select(F.col("node").alias("src"), "power"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("power").alias("votes"))
        best = free.join(votes, "node").filter("votes > 1e-12").orderBy(F.desc(F.round("votes", 9)), "node").first()
        if best is None:
            order = Window.partitionBy(F.col("rank").isNull()).orderBy("node")
            state = state.withColumn("rank", F.coalesce("rank", F.lit(turn - 1) + F.row_number().over(order)))
            break
        hit = arcs.filter(F.col("src") == best.node).select(F.col("dst").alias("node"), F.lit(1.0 / mean).alias("less"))
        state = cut(state.join(hit, "node", "left").select("node", F.greatest(F.col("power") - F.coalesce("less", F.lit(0.0)), F.lit(0.0)).alias("power"), F.when(F.col("node") == best.node, F.lit(turn)).otherwise(F.col("rank")).cast("long").alias("rank")), state)
    last = state.agg(F.max("rank").alias("m"))
    return state.join(last, how="cross").select("node", F.coalesce((F.col("m") + 1 - F.col("rank")) / F.col("m"), F.lit(0.0)).alias("voterank"))


def degree_distribution(net: Network, mode: str = "all") -> DataFrame:
    """How many nodes have each degree, and the share of nodes up to it."""
    counts = degree(net, mode).groupBy("degree").agg(F.count("*").alias("nodes"))
    upto = Window.orderBy("degree")  # as many rows as distinct degrees
    return counts.select("degree", "nodes", (F.sum("nodes").over(upto) / F.sum("nodes").over(Window.partitionBy())).alias("cumulative"))


def density(net: Network) -> DataFrame:
    """Edges over possible edges."""
    pairs = F.col("n") * (F.col("n") - 1)
    return net.nodes.agg(F.count("*").alias("n")).join(net.edges.agg(F.count("*").alias("m")), how="cross").select(F.try_divide(F.col("m") * (1 if net.directed else 2), pairs).alias("density"))


def reciprocity(net: Network) -> DataFrame:
    """Mutual over linked pairs of different nodes."""
    arcs = net.arcs().filter("src <> dst").select("src", "dst").distinct()
    pairs = arcs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    return pairs.agg(F.try_divide(F.sum(F.when(F.col("n") == 2, 1).otherwise(0)), F.count("*")).alias("reciprocity"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums: null without spread."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    spread = (n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy)
    return F.when(spread > 0, F.try_divide(n * F.sum(x * y) - sx * sy, F.sqrt(spread)))


def assortativity(net: Network) -> DataFrame:
    """Correlation of the degrees at the two ends of edges (out and in, where directed)."""
    out, into = degree(net, "out"), degree(net, "in")
    ends = net.arcs() if not net.directed else net.edges
    both = ends.join(out.select(F.col("node").alias("src"), F.col("degree").cast("double").alias("x")), "src").join(into.select(F.col("node").alias("dst"), F.col("degree").cast("double").alias("y")), "dst")
    return both.agg(pearson(F.col("x"), F.col("y")).alias("assortativity"))


def centralization_degree(net: Network, mode: str = "all") -> DataFrame:
    """Sum of distances from the largest degree over its most, loops allowed."""
    most = F.col("n") * (F.col("n") - 1) * (2 if net.directed and mode == "all" else 1)
    found = degree(net, mode).agg(F.count("*").alias("n"), F.max("degree").alias("top"), F.sum("degree").alias("s"))
    return found.select(F.try_divide(F.col("n") * F.col("top") - F.col("s"), most).alias("centralization"))
