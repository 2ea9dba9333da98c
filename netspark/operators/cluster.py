"""Edges within and between clusters; membership is a table (node, cluster)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network


def aggregate_weights(w: Column, method: str = "sum", possible: Column | None = None) -> Column:
    """Null and zero weights are left out; nothing left gives 0. density is the sum over `possible` (or the count); geomean over positives."""
    kept = F.when(w != 0, w)
    found = {
        "sum": lambda: F.sum(kept),
        "mean": lambda: F.avg(kept),
        "median": lambda: F.median(kept),
        "max": lambda: F.max(kept),
        "min": lambda: F.min(kept),
        "prod": lambda: F.product(kept),
        "density": lambda: F.try_divide(F.sum(kept), F.max(possible) if possible is not None else F.count(kept)),
        "geomean": lambda: F.exp(F.avg(F.when(w > 0, F.ln(w)))),
    }[method]()
    return F.coalesce(found, F.lit(0.0))


def check_membership(net: Network, membership: DataFrame) -> None:
    """Nodes once each, all of them known and placed, and two clusters at least."""
    names = net.nodes.select("node")
    for bad, what in ((membership.groupBy("node").count().filter("count > 1"), "nodes placed twice"), (membership.join(names, "node", "left_anti"), "unknown nodes"), (names.join(membership, "node", "left_anti"), "nodes without a cluster")):
        if not bad.isEmpty():
            raise ValueError(what)
    if membership.select("cluster").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two clusters")


def _placed(edges: DataFrame, membership: DataFrame) -> DataFrame:
    a, b = membership.select(F.col("node").alias("src"), F.col("cluster").alias("ci")), membership.select(F.col("node").alias("dst"), F.col("cluster").alias("cj"))
    return edges.join(a, "src").join(b, "dst")


def cluster_between(net: Network, membership: DataFrame, method: str = "sum", directed: bool = True) -> DataFrame:
    """(ci, cj, value) for every ordered pair of clusters: 0 on the diagonal and where there is no edge."""
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    i, j = sizes.select(F.col("cluster").alias("ci"), F.col("n").alias("ni")), sizes.select(F.col("cluster").alias("cj"), F.col("n").alias("nj"))
    cells = _placed(net.arcs(), membership).filter("ci <> cj").join(i, "ci").join(j, "cj").groupBy("ci", "cj").agg(aggregate_weights(F.col("weight"), method, F.col("ni") * F.col("nj")).alias("value"))
    grid = i.join(j, how="cross").select("ci", "cj")  # as many rows as pairs of clusters
    return grid.join(cells, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("value", F.lit(0.0)).alias("value"))


def cluster_within(net: Network, membership: DataFrame, method: str = "sum", directed: bool = True) -> DataFrame:
    """(cluster, value) over the edges inside each cluster, loops left out."""
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    possible = F.col("n") * (F.col("n") - 1) / (1 if directed else 2)
    cells = _placed(net.arcs().filter("src <> dst"), membership).filter("ci = cj").join(sizes, F.col("ci") == F.col("cluster")).groupBy("cluster").agg(aggregate_weights(F.col("weight"), method, possible).alias("value"))
    return sizes.join(cells, "cluster", "left").select("cluster", F.coalesce("value", F.lit(0.0)).alias("value"))


def modularity(net: Network, membership: DataFrame, compat: bool = False) -> DataFrame:
    """One row: sum over clusters of inside / m - out * in / m^2, on the matrix of arcs.

    For undirected networks `compat` gives the older scale that halves m but
    neither the products nor the ordered pairs.
    """
    placed = _placed(net.arcs(), membership)
    out, into = placed.groupBy(F.col("ci").alias("cluster")).agg(F.sum("weight").alias("o")), placed.groupBy(F.col("cj").alias("cluster")).agg(F.sum("weight").alias("i"))
    inside = placed.filter("ci = cj").groupBy(F.col("ci").alias("cluster")).agg(F.sum("weight").alias("s"))
    total = placed.agg(F.sum("weight").alias("m"))
    each = membership.select("cluster").distinct().join(out, "cluster", "left").join(into, "cluster", "left").join(inside, "cluster", "left").fillna(0.0).join(total, how="cross")
    m = F.col("m") / (2 if compat and not net.directed else 1)
    return each.agg(F.sum((F.col("s") - F.try_divide(F.col("o") * F.col("i"), m)) / m).alias("modularity"))


def cluster_quality(net: Network, membership: DataFrame, weighted: bool = True) -> DataFrame:
    """Per cluster: n_nodes, internal_edges (loops included), cut_edges, internal_density, avg_internal_degree, expansion, cut_ratio, conductance; null where nothing is possible."""
    w = F.col("weight") if weighted else (F.col("weight") > 0).cast("double")
    placed = _placed(net.arcs().withColumn("weight", w), membership)
    half = 1.0 if net.directed else 0.5  # arcs hold undirected edges twice
    inside = placed.filter("ci = cj").groupBy(F.col("ci").alias("cluster")).agg((half * F.sum("weight")).alias("m"))
    sides = placed.filter("ci <> cj").select(F.explode(F.array("ci", "cj")).alias("cluster"), "weight").groupBy("cluster").agg((half * F.sum("weight")).alias("c"))
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    all_ = sizes.join(inside, "cluster", "left").join(sides, "cluster", "left").fillna(0.0, ["m", "c"]).join(membership.agg(F.count("*").alias("total")), how="cross")
    n, m, c = F.col("n"), F.col("m"), F.col("c")
    possible = n * (n - 1) / (1 if net.directed else 2)
    return all_.select("cluster", n.alias("n_nodes"), m.alias("internal_edges"), c.alias("cut_edges"), F.try_divide(m, possible).alias("internal_density"), F.try_divide(2 * m, n).alias("avg_internal_degree"), F.try_divide(c, n).alias("expansion"), F.try_divide(c, n * (F.col("total") - n)).alias("cut_ratio"), F.try_divide(c, 2 * m + c).alias("conductance"))


def coverage(net: Network, membership: DataFrame) -> DataFrame:
    """Share of the weight that lies within clusters."""
    return _placed(net.arcs(), membership).agg(F.try_divide(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("coverage"))


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y, n): how many nodes two memberships put into x and y."""
    return left.select("node", F.col("cluster").alias("x")).join(right.select("node", F.col("cluster").alias("y")), "node").groupBy("x", "y").agg(F.count("*").alias("n"))


def compare_partitions(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: vi, nmi, split_join, rand, adjusted_rand of two memberships."""
    cells = contingency(left, right)
    total = cells.agg(F.sum("n").alias("t"))
    log = lambda c: F.sum(-(F.col(c) / F.col("t")) * F.ln(F.col(c) / F.col("t")))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    joint = cells.join(total, how="cross").agg(log("n").alias("hxy"), two("n").alias("p"), F.max("t").alias("t"))
    sides = []
    for key, name in (("x", "a"), ("y", "b")):
        sums = cells.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("top")).join(total, how="cross")
        sides.append(sums.agg(log("n").alias(f"h{name}"), two("n").alias(f"p{name}"), F.sum("top").alias(f"m{name}")))
    row = joint.join(sides[0], how="cross").join(sides[1], how="cross")
    pairs, expected = F.col("t") * (F.col("t") - 1) / 2, F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    return row.select(
        (2 * F.col("hxy") - F.col("ha") - F.col("hb")).alias("vi"),
        F.coalesce(F.try_divide(2 * (F.col("ha") + F.col("hb") - F.col("hxy")), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"),
        (2 * F.col("t") - F.col("ma") - F.col("mb")).alias("split_join"),
        ((pairs + 2 * F.col("p") - F.col("pa") - F.col("pb")) / pairs).alias("rand"),
        F.coalesce(F.try_divide(F.col("p") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("adjusted_rand"),
    )
