"""Layouts whose distances in the plane follow the distances in the network.

Both read the hop (or weighted) distances from pivots, all nodes where these are at most
PIVOTS, else that many by hash; so a table is pivots times nodes. Nodes that no path joins
count as half as far again as the largest distance that there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from .paths import _facing, distances

#: Most pivots; their own distances, the square of it, are the only table that the driver reads.
PIVOTS = 250
#: Up to so many nodes a node gathers all that pull at it, so that a step reads the places once and many steps make one plan.
GATHERED = 1000
#: Gathering steps of stress majorization that make one plan.
STEPS_A_JOB = 10


def _hops(net: Network, chosen: DataFrame, many: int) -> DataFrame:
    """(node, row): hops from each of `many` pivots (node, k) in the order of k, from 0; null where no path leads.

    A node's bits say which pivots have reached it, so a pass joins each arc once for all
    pivots together and ors the bits at its end. Once few nodes lack a pivot, only the arcs
    to these are walked.
    """
    words = range((many + 63) // 64)
    new, seen = [f"new{w}" for w in words], [f"seen{w}" for w in words]
    every = [(1 << min(64, many - 64 * w)) - 1 for w in words]
    every = [x - (1 << 64) if x >> 63 else x for x in every]  # signed longs
    none = F.lit(0).cast("long")
    fresh = reduce(Column.__or__, [F.col(c) != 0 for c in new])
    lacking = reduce(Column.__or__, [F.col(c) != F.lit(x) for c, x in zip(seen, every, strict=True)])

    def noted(level: int) -> Column:
        """What reaches a node at this level, as an array of one entry or of none."""
        return F.filter(F.array(F.struct(F.lit(level).alias("level"), F.array(*new).alias("bits"))), lambda _: fresh)

    bit = F.expr("shiftleft(1L, cast(k % 64 as int))")
    first = chosen.select("node", *[F.when(F.floor(F.col("k") / 64) == w, bit).otherwise(none).alias(c) for w, c in zip(words, new, strict=True)])
    start = net.nodes.select("node").join(F.broadcast(first), "node", "left").fillna(0, new)  # at most PIVOTS rows
    state = cut(start.select("node", *new, *[F.col(c).alias(x) for c, x in zip(new, seen, strict=True)], noted(0).alias("found")))
    arcs = net.arcs().filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    level = 0
    while True:
        rest = state.agg(F.count("*").alias("nodes"), F.count_if(fresh).alias("fresh"), F.count_if(lacking).alias("lacking")).first()
        if not rest.fresh or not rest.lacking:
            break
        level += 1
        walked = arcs.join(state.filter(lacking).select(F.col("node").alias("v")), "v", "left_semi") if rest.lacking * 10 < rest.nodes else arcs
        met = walked.join(state.filter(fresh).select(F.col("node").alias("u"), *new), "u").groupBy(F.col("v").alias("node")).agg(*[F.bit_or(c).alias(f"met_{c}") for c in new])
        gained = [F.coalesce(F.col(f"met_{c}").bitwiseAND(F.bitwise_not(F.col(x))), none).alias(c) for c, x in zip(new, seen, strict=True)]
        moved = state.select("node", *seen, "found").join(met, "node", "left").select("node", *seen, "found", *gained)
        state = cut(moved.select("node", *new, *[F.col(x).bitwiseOR(F.col(c)).alias(x) for c, x in zip(new, seen, strict=True)], F.concat("found", noted(level)).alias("found")), state)
    by = lambda k: lambda e: F.getbit(F.element_at(e["bits"], F.floor(k / 64).cast("int") + 1), F.pmod(k, F.lit(64))) == 1
    at = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.get(F.filter("found", by(k)), F.lit(0))["level"].cast("double"))
    return state.select("node", at.alias("row"))


def _pivot_rows(net: Network, weighted: bool, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(node, row) of every node's distances from the pivots in the order of k, and the pivots (node, k), k from 0 by name."""
    flat = _facing(net, "all")
    flat = Network(_kept(flat.nodes.select("node")), _kept(flat.edges), flat.directed)
    chosen = flat.nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
    chosen = cut(chosen.select("node", (F.row_number().over(Window.orderBy("node")) - 1).alias("k")))  # at most PIVOTS rows
    many = chosen.count()
    if not many:
        return flat.nodes.select("node", F.array().cast("array<double>").alias("row")), chosen
    if weighted:
        found = distances(flat, weighted=True, sources=chosen.select("node")).join(F.broadcast(chosen.withColumnRenamed("node", "source")), "source")
        pairs = flat.nodes.select("node").crossJoin(F.broadcast(chosen.select("k"))).join(found.select("node", "k", "dist"), ["node", "k"], "left")
        rows = cut(pairs.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "dist"))).alias("all")).select("node", F.transform("all", lambda e: e["dist"]).alias("row")))
    else:
        rows = cut(_hops(flat, chosen, many))
    far = 1.5 * (rows.agg(F.max(F.array_max("row"))).first()[0] or 0.0) or 1.0
    return rows.select("node", F.transform("row", lambda d: F.coalesce(d, F.lit(far))).alias("row")), chosen


def _kept(df: DataFrame) -> DataFrame:
    """df itself if `cut` has stored it, else what `cut` makes of it."""
    return df if hasattr(df, "_stored_at") else cut(df)


def pivot_distances(net: Network, weighted: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """(pivot, node, d) of every node from each of at most `pivots` pivots, in either direction of the edges."""
    return _as_pairs(*_pivot_rows(net, weighted, pivots))


def _as_pairs(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    names = F.broadcast(chosen.select(F.col("node").alias("pivot"), "k"))  # at most PIVOTS rows
    return cut(rows.select("node", F.posexplode("row").alias("k", "d")).join(names, "k").select("pivot", "node", "d"))


def classical_scaling(net: Network, weighted: bool = False, pivots: int = PIVOTS, dimensions: int = 2) -> DataFrame:
    """(node, x, y, ..): multidimensional scaling of the network's distances.

    The squared distances are centred twice; with all nodes as pivots the coordinates are
    its leading eigenvectors times the roots of their eigenvalues. With fewer, they are the
    left singular vectors of the pivots' columns, scaled up by how many nodes a pivot stands
    for. An axis without a positive eigenvalue is 0. Axes turn so that the first pivot that
    is not at 0 lies on the positive side.
    """
    return _scaled(*_pivot_rows(net, weighted, pivots), dimensions)


def _scaled(rows: DataFrame, chosen: DataFrame, dimensions: int = 2) -> DataFrame:
    n = rows.count()
    names = ["x", "y", "z"][:dimensions]
    order = [r.node for r in chosen.orderBy("k").collect()]
    means = rows.select(F.posexplode("row").alias("k", "d")).groupBy("k").agg(F.avg(F.col("d") * F.col("d")).alias("q")).orderBy("k").collect()
    means = [r.q for r in means]
    total = sum(means) / max(len(means), 1)
    own_mean = F.aggregate("row", F.lit(0.0), lambda a, d: a + d * d) / max(len(means), 1)
    columns = F.array(*[F.lit(q) for q in means]) if means else F.array().cast("array<double>")
    centred = rows.select("node", "row", own_mean.alias("mean")).select("node", F.zip_with("row", columns, lambda d, q: -0.5 * (d * d - q - F.col("mean") + total)).alias("row"))
    rows = cut(centred)

    def outer(batches: Iterator) -> Iterator:
        import pandas as pd

        made = np.zeros((len(order), len(order)))
        for batch in batches:
            if len(batch):
                at = np.stack(batch["row"].to_list())
                made += at.T @ at
        yield pd.DataFrame({"i": np.arange(len(order)), "row": list(made)})

    own = {r.node: r.row for r in rows.join(F.broadcast(chosen.select("node")), "node", "left_semi").collect()}
    own = np.array([own[p] for p in order]).reshape(len(order), len(order))
    if len(order) == n:
        values, vectors = np.linalg.eigh(own)
        roots = np.sqrt(np.maximum(values, 0))
    else:
        gram = np.zeros((len(order), len(order)))
        parts = rows.select("row").mapInPandas(outer, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
        for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            gram[r.i, r.j] = r.v
        squares, vectors = np.linalg.eigh(gram)
        values = np.sqrt(np.maximum(squares, 0))
        # Which way an eigenvector of the square points is told by the pivots' own rows.
        values *= np.sign(np.einsum("ik,ij,jk->k", vectors, own, vectors))
        roots = np.sqrt(np.maximum(values, 0) * np.sqrt(n / len(order)))
    weights, noise = [], 1e-9 * np.abs(values).max(initial=0.0)
    for k in np.argsort(-values, kind="stable")[:dimensions]:
        if values[k] > noise:
            at = own @ vectors[:, k]
            first = at[np.abs(at) > 1e-9 * np.abs(at).max()][0]
            weights.append(vectors[:, k] * np.sign(first) * roots[k] / values[k])
    weights += [np.zeros(len(order))] * (dimensions - len(weights))
    along = lambda w: F.aggregate(F.zip_with("row", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.select("node", *[along(w).alias(c) for c, w in zip(names, weights, strict=True)])


def stress(at: DataFrame, d: DataFrame) -> DataFrame:
    """One row, stress: the squared errors of the distances between nodes and pivots, each over its square."""
    return d.join(_as_pivot(at), "pivot").join(at, "node").filter("node <> pivot").agg(F.sum(F.pow((F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) - F.col("d")) / F.col("d"), 2)).alias("stress"))


def _as_pivot(at: DataFrame) -> DataFrame:
    return at.select(F.col("node").alias("pivot"), F.col("x").alias("px"), F.col("y").alias("py"))


def stress_step(at: DataFrame, d: DataFrame) -> DataFrame:
    """at (node, x, y) after one step. Every pair of a node and a pivot asks both ends to stand d apart on the line
    between them; a node moves half of the way to the mean of what is asked, by 1 / d^2. So the stress never rises,
    though all nodes move at once: twice the diagonal of a Laplacian bounds it."""
    pairs = d.filter("node <> pivot").join(_as_pivot(at), "pivot").join(at, "node")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    far = F.hypot(dx, dy)
    w, pull = 1 / (F.col("d") * F.col("d")), F.when(far > 1e-12, F.col("d") / far - 1).otherwise(0.0)
    ends = F.explode(F.array(
        F.struct(F.col("node").alias("node"), (dx * pull * w).alias("fx"), (dy * pull * w).alias("fy"), w.alias("w")),
        F.struct(F.col("pivot").alias("node"), (-dx * pull * w).alias("fx"), (-dy * pull * w).alias("fy"), w.alias("w")),
    ))
    asked = pairs.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.fx").alias("fx"), F.sum("e.fy").alias("fy"), F.sum("e.w").alias("w"))
    move = lambda c: F.col(c) + F.coalesce(F.col(f"f{c}") / (2 * F.col("w")), F.lit(0.0))
    return at.join(asked, "node", "left").select("node", move("x").alias("x"), move("y").alias("y"))


def _both_ways(d: DataFrame) -> DataFrame:
    """(node, other, d, w, own): each pair of `d` seen from both of its ends, and every node with itself."""
    pairs = d.filter("node <> pivot")
    seen = pairs.select("node", F.col("pivot").alias("other"), "d").union(pairs.select("pivot", "node", "d")).select("*", (1 / (F.col("d") * F.col("d"))).alias("w"), F.lit(False).alias("own"))
    return seen.union(d.select("node").distinct().select("node", "node", F.lit(0.0), F.lit(0.0), F.lit(True)))


def gathered_step(at: DataFrame, both: DataFrame) -> DataFrame:
    """The same step as `stress_step` by gathering; both: the pairs of `_both_ways`."""
    met = both.join(at.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.collect_list(F.struct("x", "y", "d", "w", "own")).alias("all"))
    met = met.select("node", F.filter("all", lambda o: o["own"])[0].alias("me"), F.filter("all", lambda o: ~o["own"]).alias("rest"))

    def add(sum_, o):
        dx, dy = F.col("me.x") - o["x"], F.col("me.y") - o["y"]
        far = F.hypot(dx, dy)
        by = F.when(far > 1e-12, o["d"] / far - 1).otherwise(0.0) * o["w"]
        return F.struct((sum_["fx"] + dx * by).alias("fx"), (sum_["fy"] + dy * by).alias("fy"), (sum_["w"] + o["w"]).alias("w"))

    asked = met.withColumn("f", F.aggregate("rest", F.struct(F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("w")), add))
    move = lambda c: F.col(f"me.{c}") + F.coalesce(F.try_divide(F.col(f"f.f{c}"), 2 * F.col("f.w")), F.lit(0.0))
    return asked.select("node", move("x").alias("x"), move("y").alias("y"))


def layout_kamada_kawai(net: Network, iterations: int = 300, weighted: bool = True, initial: DataFrame | None = None, tolerance: float = 1e-3, pivots: int = PIVOTS) -> DataFrame:
    """(node, x, y) that minimise the stress of the distances, by majorization from `initial`, else from multidimensional scaling.

    Weights are lengths and must be positive. Ends when STEPS_A_JOB steps lower the stress by
    less than `tolerance` of it, or after `iterations` steps. Nodes that start on one place
    stay there, so places of the scaling are moved apart a little by hash first.
    """
    if weighted and not net.edges.filter("weight <= 0").isEmpty():
        raise ValueError("lengths must be positive")
    rows, chosen = _pivot_rows(net, weighted, pivots)
    d = _as_pairs(rows, chosen)
    if initial is None:
        spread = lambda seed: (F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.1
        initial = _scaled(rows, chosen).select("node", (F.col("x") + spread(1)).alias("x"), (F.col("y") + spread(2)).alias("y"))
    at = cut(net.nodes.select("node").join(initial.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "node"))
    before = stress(at, d).first().stress
    few = net.n_nodes() <= GATHERED
    both = cut(_both_ways(d)) if few else None
    for done in range(0, iterations, STEPS_A_JOB):
        for i in range(min(STEPS_A_JOB, iterations - done)):
            if few:
                at = gathered_step(at, both)
            else:
                at = cut(stress_step(at, d), at)
        at = cut(at) if few else at
        now = stress(at, d).first().stress
        if not now or before - now < tolerance * before:
            break
        before = now
    return at


def layout_mds(net: Network, pivots: int = PIVOTS) -> DataFrame:
    """(node, x, y) by multidimensional scaling of hop distances."""
    return classical_scaling(net, False, pivots)
