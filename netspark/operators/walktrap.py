"""Walktrap: communities between which short random walks seldom pass.

A node is the vector of where a walk of `steps` steps from it ends, each place divided
by the root of its degree. Of neighbouring communities those merge whose union adds
least to the squared distances from the communities' means (Ward's criterion). Pairs
that are each other's nearest merge in the same round, so a round takes a large part of
the communities; the dendrogram is cut where modularity is highest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut, discard
from .community import _ties
from .components import connected_components
from .ordered import running


def walk_vectors(net: Network, steps: int = 4, weighted: bool = True) -> DataFrame:
    """(c, k, x): where walks from node c end after so many steps, over the root of the degree of k.

    Every node has a loop of the mean weight of its edges, or of 1 if it has none.
    """
    ties = _ties(net, weighted).filter("src <> dst")
    mean = ties.groupBy(F.col("src").alias("node")).agg(F.avg("w").alias("m"))
    loops = net.nodes.select("node").join(mean, "node", "left").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.coalesce("m", F.lit(1.0)).alias("w"))
    arcs = cut(ties.union(loops))
    degree = cut(arcs.groupBy("src").agg(F.sum("w").alias("d")))
    pace = cut(arcs.join(degree, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("p")))
    at = net.nodes.select(F.col("node").alias("c"), F.col("node").alias("k"), F.lit(1.0).alias("x"))
    for _ in range(steps):
        at = at.join(pace, F.col("k") == F.col("src")).groupBy("c", F.col("dst").alias("k")).agg(F.sum(F.col("x") * F.col("p")).alias("x"))
    made = cut(at.join(degree, F.col("k") == F.col("src")).select("c", "k", (F.col("x") / F.sqrt("d")).alias("x")))
    discard(arcs, degree, pace)
    return made


def _spread(pairs: DataFrame, vectors: DataFrame, size: DataFrame, n: int) -> DataFrame:
    """(a, b, delta): what the union of two communities adds to the squared distances, a mean for each of n nodes."""
    ends = pairs.select("a", "b", F.col("a").alias("c"), F.lit(1.0).alias("sign")).union(pairs.select("a", "b", "b", F.lit(-1.0)))
    apart = ends.join(vectors, "c").groupBy("a", "b", "k").agg(F.sum(F.col("sign") * F.col("x")).alias("x")).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("x")).alias("r2"))
    na, nb = (size.select(F.col("c").alias(e), F.col("n").alias(f"n_{e}")) for e in "ab")
    share = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    return apart.join(na, "a").join(nb, "b").select("a", "b", (share * F.col("r2") / n).alias("delta"))


def merges(net: Network, steps: int = 4, weighted: bool = True, most_rounds: int = 10_000) -> DataFrame:
    """(step, a, b, height, modularity): the dendrogram in order of height; b goes into a, which is the lesser name.

    height is what the merge adds to the squared distances (never less than below it);
    modularity is that of the communities after the step.
    """
    vectors = walk_vectors(net, steps, weighted)
    ties = cut(_ties(net, weighted))
    m2, n = ties.agg(F.sum("w")).first()[0] or 1.0, net.nodes.count()
    degree = ties.groupBy(F.col("src").alias("c")).agg(F.sum("w").alias("deg"))
    state = cut(net.nodes.select(F.col("node").alias("c")).join(degree, "c", "left").select("c", F.lit(1).cast("long").alias("n"), F.coalesce("deg", F.lit(0.0)).alias("deg"), F.lit(0.0).alias("top")))
    alone = ties.agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))).alias("w")).first()[0] or 0.0
    first = alone / m2 - (state.agg(F.sum(F.col("deg") * F.col("deg"))).first()[0] or 0.0) / (m2 * m2)
    pairs = ties.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    pairs = cut(pairs.join(_spread(pairs, vectors, state, n), ["a", "b"]))
    done = []
    for number in range(most_rounds):
        near = pairs.select("a", "b", F.struct(F.round("delta", 12).alias("d"), "a", "b").alias("rank"))
        best = near.select(F.explode(F.array("a", "b")).alias("c"), "rank").groupBy("c").agg(F.min("rank").alias("rank"))
        mutual = best.groupBy("rank").agg(F.count("*").alias("ends")).filter("ends = 2").select("rank.a", "rank.b")
        one, two = (state.select(F.col("c").alias(e), F.col("deg").alias(f"deg_{e}"), F.col("top").alias(f"top_{e}")) for e in "ab")
        met = pairs.join(mutual, ["a", "b"]).join(one, "a").join(two, "b")
        gain = 2 * F.col("w") / m2 - 2 * F.col("deg_a") * F.col("deg_b") / (m2 * m2)
        met = cut(met.select("a", "b", F.greatest("delta", "top_a", "top_b").alias("height"), gain.alias("gain"), F.lit(number).alias("round")))
        if met.isEmpty():
            break
        done.append(met)
        to = met.select(F.col("b").alias("c"), F.col("a").alias("to"), "height").union(met.select("a", "a", "height"))
        moved = cut(state.join(to, "c", "left").select("c", F.coalesce("to", "c").alias("to"), "n", "deg", F.coalesce("height", "top").alias("top"), F.col("to").isNotNull().alias("new")))
        state = cut(moved.groupBy(F.col("to").alias("c")).agg(F.sum("n").alias("n"), F.sum("deg").alias("deg"), F.max("top").alias("top")), state)
        mean = vectors.join(moved.select("c", "to", "n"), "c").groupBy("to", "k").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
        vectors = cut(mean.join(state.select(F.col("c").alias("to"), "n"), "to").select(F.col("to").alias("c"), "k", (F.col("x") / F.col("n")).alias("x")), vectors)
        for end in "ab":
            pairs = pairs.join(moved.select(F.col("c").alias(end), F.col("to").alias(f"to_{end}"), F.col("new").alias(f"new_{end}")), end)
        known = F.when(~F.col("new_a") & ~F.col("new_b"), F.col("delta"))
        pairs = pairs.filter("to_a <> to_b").groupBy(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).agg(F.sum("w").alias("w"), F.max(known).alias("known"))
        pairs = cut(pairs)
        fresh = _spread(pairs.filter("known is null").select("a", "b"), vectors, state, n)
        pairs = cut(pairs.join(fresh, ["a", "b"], "left").select("a", "b", "w", F.coalesce("known", "delta").alias("delta")), pairs)
    else:
        raise RuntimeError("merges did not end")
    if not done:
        return net.nodes.select(F.lit(0).cast("long").alias("step"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("height"), F.lit(0.0).alias("modularity")).limit(0)
    order = ["height", "round", "a"]
    placed = running(running(reduce(DataFrame.union, done), order, "gain", "sum"), order, name="step")
    return placed.select("step", "a", "b", "height", (F.col("sum") + first).alias("modularity"))


def walktrap(net: Network, weighted: bool = True, steps: int = 4) -> DataFrame:
    """(node, community): the dendrogram of `merges` after the step of the highest modularity (the first of equal ones), or no merge at all if none is worth it."""
    tree = cut(merges(net, steps, weighted))
    ties = _ties(net, weighted)
    m2 = ties.agg(F.sum("w")).first()[0] or 1.0
    degree = ties.groupBy("src").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("own"))
    start = degree.agg(F.sum(F.col("own") / m2 - F.col("k") * F.col("k") / (m2 * m2))).first()[0] or 0.0
    best = tree.agg(F.max(F.struct(F.round("modularity", 12).alias("q"), (-F.col("step")).alias("step"))).alias("m")).first().m
    last = -best.step if best and best.q > round(start, 12) else 0
    joined = connected_components(tree.filter(F.col("step") <= last), "a", "b")
    return net.nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
