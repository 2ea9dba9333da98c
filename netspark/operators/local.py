"""Triangles and other measures of a node's neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network


def _ordered(net: Network) -> DataFrame:
    """Simple edges from the end of lower degree (then name) to the other, so that hubs fan out little."""
    around = net.around()
    deg = around.groupBy("node").agg(F.count("*").alias("k"))
    s = net.simple()
    both = s.join(deg.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src").join(deg.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst")
    first = (F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("src") < F.col("dst")))
    return both.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"))


def triangles(net: Network) -> DataFrame:
    """(a, b, c): every triangle once."""
    e = _ordered(net)
    wedge = e.alias("x").join(e.alias("y"), F.col("x.u") == F.col("y.u")).filter("x.v < y.v").select(F.col("x.u").alias("a"), F.col("x.v").alias("b"), F.col("y.v").alias("c"))
    s = net.simple()
    return wedge.join(s, (F.col("b") == F.col("src")) & (F.col("c") == F.col("dst"))).select("a", "b", "c")


def triangle_count(net: Network) -> DataFrame:
    """(node, triangles)."""
    each = triangles(net).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return net.nodes.select("node").join(each, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def transitivity_local(net: Network, isolates: str = "nan") -> DataFrame:
    """Linked share of the pairs of neighbours; nodes with fewer than two give NaN or 0."""
    deg = net.around().groupBy("node").agg(F.count("*").alias("k"))
    none = F.lit(float("nan") if isolates == "nan" else 0.0)
    return triangle_count(net).join(deg, "node", "left").select("node", F.when(F.coalesce("k", F.lit(0)) < 2, none).otherwise(F.try_divide(2 * F.col("triangles"), F.col("k") * (F.col("k") - 1))).alias("transitivity"))


def transitivity_global(net: Network) -> DataFrame:
    """Three times the triangles over the connected triples."""
    triples = net.around().groupBy("node").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("t"))
    return triangles(net).agg(F.count("*").alias("n")).join(triples, how="cross").select(F.try_divide(3 * F.col("n"), F.col("t")).alias("transitivity"))


def transitivity_barrat(net: Network) -> DataFrame:
    """Weighted share of closed pairs of neighbours (Barrat)."""
    w = net.edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))
    both = w.union(w.select("b", "a", "w"))
    stats = both.groupBy("a").agg(F.count("*").alias("k"), F.sum("w").alias("s"))
    t = triangles(net)
    corners = t.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("h")).union(t.select("b", "a", "c")).union(t.select("c", "a", "b"))
    ij, ih = both.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("w").alias("wij")), both.select(F.col("a").alias("i"), F.col("b").alias("h"), F.col("w").alias("wih"))
    closed = corners.join(ij, ["i", "j"]).join(ih, ["i", "h"]).groupBy("i").agg(F.sum(F.col("wij") + F.col("wih")).alias("closed"))
    found = stats.join(closed, stats["a"] == closed["i"], "left").select(F.col("a").alias("node"), F.when(F.col("k") < 2, float("nan")).otherwise(F.try_divide(F.coalesce("closed", F.lit(0.0)), F.col("s") * (F.col("k") - 1))).alias("transitivity"))
    return net.nodes.select("node").join(found, "node", "left").select("node", F.coalesce("transitivity", F.lit(float("nan"))).alias("transitivity"))


def constraint(net: Network) -> DataFrame:
    """Burt's constraint: sum over contacts of (p_ij + sum_q p_iq p_qj)^2; NaN without contacts."""
    arcs = net.edges.filter("src <> dst")
    tie = arcs.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight").union(arcs.select("dst", "src", "weight")).groupBy("i", "j").agg(F.sum("weight").alias("t"))
    p = tie.withColumn("p", F.col("t") / F.sum("t").over(Window.partitionBy("i"))).select("i", "j", "p")
    q = p.select(F.col("i").alias("q"), F.col("j").alias("to"), F.col("p").alias("pq"))
    indirect = p.join(q, p["j"] == q["q"]).filter("i <> to").groupBy("i", "to").agg(F.sum(F.col("p") * F.col("pq")).alias("via")).withColumnRenamed("to", "j")
    each = p.join(indirect, ["i", "j"], "left").groupBy("i").agg(F.sum(F.pow(F.col("p") + F.coalesce("via", F.lit(0.0)), 2)).alias("constraint"))
    return net.nodes.select("node").join(each, F.col("node") == F.col("i"), "left").select("node", F.coalesce("constraint", F.lit(float("nan"))).alias("constraint"))


def rich_club(net: Network, k: int | None = None) -> DataFrame:
    """Density among the nodes of degree above k (the median degree by default); null for fewer than two."""
    deg = net.nodes.select("node").join(net.around().groupBy("node").agg(F.count("*").alias("k")), "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"))
    limit = deg.agg((F.lit(float(k)) if k is not None else F.median("k")).alias("limit"))
    rich = deg.join(limit, how="cross").filter("k > limit")
    linked = net.simple().join(rich.select(F.col("node").alias("src")), "src", "left_semi").join(rich.select(F.col("node").alias("dst")), "dst", "left_semi").agg(F.count("*").alias("m"))
    return rich.agg(F.count("*").alias("n")).join(linked, how="cross").join(limit, how="cross").select("limit", "n", "m", F.try_divide(2 * F.col("m"), F.col("n") * (F.col("n") - 1)).alias("phi"))


def clique_size(net: Network) -> DataFrame:
    """Size of the largest clique, by growing all cliques of a size by joins.

    A state is the set of nodes that can still extend a clique; memory follows
    the number of cliques, so this is for sparse networks.
    """
    from ..session import cut

    after = net.simple().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("next"))
    best, state = (1 if not net.nodes.isEmpty() else 0), after.select(F.col("next").alias("can"))
    while True:
        state = cut(state)
        if state.isEmpty():
            break
        best += 1
        grown = state.select("can", F.explode("can").alias("x")).join(after, F.col("x") == F.col("src"))
        state = grown.select(F.array_intersect("can", "next").alias("can")).filter(F.size("can") > 0)
    return net.nodes.sparkSession.range(1).select(F.lit(best).cast("long").alias("clique_size"))
