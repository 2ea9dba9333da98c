"""Layouts by forces: every node pushes every other away, edges pull their ends together.

A step adds up the forces on each node and moves it. Exact steps join all pairs of nodes.
For large networks the plane is halved into cells again and again, as long as a cell has
some nodes: a node meets the nodes of its own and the neighbouring smallest cells one by
one, and at each level the cells that are next to its parent cell's neighbours, but not to
its own cell, as one mass at their centre. Each pair of nodes is met at one level only, so
a step has some 27 rows a node and level instead of n.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Up to so many nodes steps are exact, unless asked otherwise.
EXACT = 1000
#: Nodes of a smallest cell, about.
CELL = 8
#: Exact steps that make one plan.
STEPS_A_JOB = 8


def _even(seed: int) -> Column:
    """A number from 0 to 1 by a hash of the node."""
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _push(dx: Column, dy: Column, strength: float, least: float, mass: Column | float = 1.0) -> tuple[Column, Column]:
    """The push of `mass` nodes at a distance: strength over the distance; those nearer than `least` count as that far."""
    d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(least))
    return dx / d * (strength / d) * mass, dy / d * (strength / d) * mass


def pair_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other, w, own) of all pairs of at most EXACT nodes (or of as many as exact steps are asked for), w being the weight of the edges between them."""
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).groupBy(F.col("src").alias("node"), F.col("dst").alias("other")).agg(F.sum("w").alias("w"))
    every = nodes.select("node").join(nodes.select(F.col("node").alias("other")), how="cross")
    return every.join(both, ["node", "other"], "left").select("node", "other", F.coalesce("w", F.lit(0.0)).alias("w"), (F.col("node") == F.col("other")).alias("own"))


def step_exact(at: DataFrame, pairs: DataFrame, push: Callable[[Column], Column], pull: Callable[[Column], Column], move: Callable[[Column, Column, Column], tuple[Column, Column]]) -> DataFrame:
    """at (node, x, y, ax, ay) after one step. push and pull: what a distance is multiplied by; move: the new place from (own place, fx, fy).

    A node gathers all others, at once and once, so that several steps make one plan.
    """
    met = pairs.join(at.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.collect_list(F.struct("x", "y", "ax", "ay", "w", "own")).alias("all"))
    met = met.select("node", F.filter("all", lambda o: o["own"])[0].alias("me"), F.filter("all", lambda o: ~o["own"]).alias("rest"))

    def add(sum_: Column, o: Column) -> Column:
        dx, dy = F.col("me.x") - o["x"], F.col("me.y") - o["y"]
        d = F.sqrt(dx * dx + dy * dy)
        by = push(d) - pull(d) * o["w"]
        return F.struct((sum_["fx"] + dx * by).alias("fx"), (sum_["fy"] + dy * by).alias("fy"))

    pushed = met.withColumn("f", F.aggregate("rest", F.struct(F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy")), add))
    x, y = move(F.col("me"), F.col("f.fx"), F.col("f.fy"))
    return pushed.select("node", x.alias("x"), y.alias("y"), F.col("me.ax").alias("ax"), F.col("me.ay").alias("ay"))


def push_cells(at: DataFrame, n: int, strength: float, least: float) -> DataFrame:
    """(node, fx, fy) with far nodes taken together by cells."""
    deepest = max(2, math.ceil(math.log(max(n / CELL, 2), 4)))
    box = at.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("wide"))
    inside = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("wide") * (1 << deepest)), F.lit((1 << deepest) - 1)).cast("int")
    placed = cut(at.join(F.broadcast(box), how="cross").select("node", "x", "y", inside("x", "x0").alias("cx"), inside("y", "y0").alias("cy")))
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda a: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    near = placed.select("node", "x", "y", "cx", "cy", around.alias("o")).select("node", "x", "y", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
    other = placed.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    push = _push(dx, dy, strength, least)
    force = near.join(other, ["cx", "cy"]).filter("node <> other").select("node", push[0].alias("fx"), push[1].alias("fy"))
    masses = placed.groupBy("cx", "cy").agg(F.count("*").alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    for level in range(deepest, 1, -1):
        up = deepest - level
        cell = lambda c: F.shiftright(c, up)  # noqa: B023, E731
        here = masses.groupBy(cell("cx").alias("gx"), cell("cy").alias("gy")).agg(F.sum("m").alias("m"), (F.sum("sx") / F.sum("m")).alias("ox"), (F.sum("sy") / F.sum("m")).alias("oy"))
        # Children of the neighbours of a cell's parent: six by six, of which those next to the cell itself go one level down.
        span = F.sequence(F.lit(-2), F.lit(3))
        wide = F.explode(F.flatten(F.transform(span, lambda a: F.transform(span, lambda b: F.struct(a.alias("a"), b.alias("b"))))))  # noqa: B023
        asked = placed.select("node", "x", "y", cell("cx").alias("ux"), cell("cy").alias("uy"), wide.alias("o"))
        asked = asked.select("node", "x", "y", "ux", "uy", (F.col("ux") - F.col("ux") % 2 + F.col("o.a")).alias("gx"), (F.col("uy") - F.col("uy") % 2 + F.col("o.b")).alias("gy"))
        asked = asked.filter("abs(gx - ux) > 1 or abs(gy - uy) > 1")
        push = _push(dx, dy, strength, least, F.col("m"))
        force = force.union(asked.join(here, ["gx", "gy"]).select("node", push[0], push[1]))
    return force.groupBy("node").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _pulls(at: DataFrame, edges: DataFrame, strength: Callable[[Column], Column]) -> DataFrame:
    """(node, fx, fy) of edges (src, dst, w): strength of the distance over the distance, times w, on both ends."""
    a, b = (at.select(F.col("node").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}")) for e in ("src", "dst"))
    dx, dy = F.col("x_src") - F.col("x_dst"), F.col("y_src") - F.col("y_dst")
    force = strength(F.sqrt(dx * dx + dy * dy)) * F.col("w")
    both = edges.join(a, "src").join(b, "dst").select("src", "dst", (dx * force).alias("fx"), (dy * force).alias("fy"))
    return both.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")), F.struct(F.col("dst").alias("node"), "fx", "fy"))).alias("f")).select("f.*")


def _steps(at: DataFrame, edges: DataFrame, n: int, exact: bool, strength: float, least: float, pull: Callable[[Column], Column], moves: list) -> DataFrame:
    """at (node, x, y, ax, ay) after all moves, each a function (own place, fx, fy) to the new place."""
    if exact:
        pairs = cut(pair_table(at, edges))
        push = lambda d: strength / (F.greatest(d, F.lit(least)) * F.greatest(d, F.lit(least)))
        for i in range(0, len(moves), STEPS_A_JOB):
            old = at
            for move in moves[i : i + STEPS_A_JOB]:
                at = step_exact(at, pairs, push, pull, move)
            at = cut(at, old)
        return at
    for move in moves:
        force = push_cells(at.select("node", "x", "y"), n, strength, least).union(_pulls(at, edges, pull)).groupBy("node").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        moved = at.join(force, "node", "left").fillna(0.0, ["fx", "fy"]).withColumn("me", F.struct("x", "y", "ax", "ay"))
        x, y = move(F.col("me"), F.col("fx"), F.col("fy"))
        at = cut(moved.select("node", x.alias("x"), y.alias("y"), "ax", "ay"), at)
    return at


def layout_spring(
    net, iterations: int = 500, cooling: float = 0.95, repulsion: float = 1.0, attraction: float = 1.0, seed: int = 42, initial: DataFrame | None = None,
    max_displacement: float | None = None, anchor_strength: float = 0.0, exact: bool | None = None, tolerance: float = 1e-6,
) -> DataFrame:
    """(node, x, y) by Fruchterman and Reingold, within 0.05 .. 0.95.

    Edges pull by their weights. initial: (node, x, y) to begin with, which are anchors
    too: pulls towards them by anchor_strength, and a last move back to within
    max_displacement. A step moves no node further than its temperature, which falls by
    `cooling`; steps that all together move none by `tolerance` are left out.
    """
    n = net.n_nodes()
    if n <= 1:
        return net.nodes.select("node", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    at = net.nodes.select("node", _even(seed).alias("x"), _even(seed + 1).alias("y")) if initial is None else net.nodes.select("node").join(initial.select("node", "x", "y"), "node")
    at = cut(at.select("node", "x", "y", F.col("x").alias("ax"), F.col("y").alias("ay")))
    if net.edges.isEmpty():
        return at.select("node", "x", "y")
    edges = cut(net.edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum(F.abs("weight")).alias("w")))
    k, heats = 1 / math.sqrt(n), [0.1 * cooling**i for i in range(iterations)]
    heats = [h for h in heats if cooling >= 1 or h / (1 - cooling) >= tolerance]

    def moving(heat: float):
        def move(me: Column, fx: Column, fy: Column) -> tuple[Column, Column]:
            if initial is not None and anchor_strength > 0:
                fx, fy = fx + (me["ax"] - me["x"]) * anchor_strength, fy + (me["ay"] - me["y"]) * anchor_strength
            f = F.sqrt(fx * fx + fy * fy)
            share = F.when(f > 0, F.least(f, F.lit(heat)) / f).otherwise(0.0)
            held = lambda c: F.least(F.greatest(c, F.lit(0.05)), F.lit(0.95))
            return held(me["x"] + fx * share), held(me["y"] + fy * share)

        return move

    # The push is strength / distance along the unit vector; the pull weight * distance^2 / k along it.
    at = _steps(at, edges, n, n <= EXACT if exact is None else exact, repulsion * k * k, 0.001, lambda d: attraction * F.greatest(d, F.lit(0.001)) / k, [moving(h) for h in heats])
    if initial is not None and max_displacement is not None:
        dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
        d = F.sqrt(dx * dx + dy * dy)
        back = F.when(d > max_displacement, max_displacement / d).otherwise(1.0)
        at = at.select("node", (F.col("ax") + dx * back).alias("x"), (F.col("ay") + dy * back).alias("y"))
    return at.select("node", "x", "y")


def layout_gephi_fr(net, area: float = 10_000.0, gravity: float = 10.0, speed: float = 1.0, niter: int = 100, seed: int = 42, initial: DataFrame | None = None, exact: bool | None = None) -> DataFrame:
    """(node, x, y): the forces of Fruchterman and Reingold with a pull to the middle, at a constant speed, from places within 500 of it."""
    n = net.n_nodes()
    at = net.nodes.select("node", (_even(seed) * 1000 - 500).alias("x"), (_even(seed + 1) * 1000 - 500).alias("y")) if initial is None else net.nodes.select("node").join(initial.select("node", "x", "y"), "node")
    if not n:
        return at
    at = cut(at.select("node", "x", "y", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay")))
    k, pace = math.sqrt(10_000.0 * area / (1 + n)), speed / 800
    far = math.sqrt(10_000.0 * area) / 10 * pace
    edges = cut(net.edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))

    def move(me: Column, fx: Column, fy: Column) -> tuple[Column, Column]:
        fx, fy = (fx - me["x"] * (0.01 * k * gravity)) * pace, (fy - me["y"] * (0.01 * k * gravity)) * pace
        f = F.sqrt(fx * fx + fy * fy)
        share = F.when(f > far, far / f).otherwise(1.0)
        return me["x"] + fx * share, me["y"] + fy * share

    return _steps(at, edges, n, n <= EXACT if exact is None else exact, k * k, 1e-12, lambda d: d / k, [move] * niter).select("node", "x", "y")
