"""Coordinates by formula; nodes stand in the order of their names."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import spanning_forest
from .components import connected_components
from .forces import layout_gephi_fr, layout_spring
from .ordered import running
from .stress import layout_kamada_kawai, layout_mds


def _numbered(nodes: DataFrame, *keys: str) -> DataFrame:
    """nodes with i, from 0 in the order of names (within the keys), and n, how many there are."""
    if not keys:
        count = F.broadcast(nodes.agg(F.count("*").alias("n")))  # one row
        return running(nodes, ["node"], name="i").withColumn("i", F.col("i") - 1).join(count, how="cross")
    return nodes.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("node")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def layout_oval(nodes: DataFrame, ratio: float = 1.5, start: float = math.pi / 2, clockwise: bool = True) -> DataFrame:
    """(node, x, y) on an ellipse about (0.5, 0.5); one node stands in the middle.

    Clockwise turns the list of angles round, so the first node takes the last one.
    """
    place = F.col("n") - 1 - F.col("i") if clockwise else F.col("i")
    angle = start + 2 * math.pi * place / F.col("n")
    x, y = 0.5 + 0.4 * math.sqrt(ratio) * F.cos(angle), 0.5 + 0.4 / math.sqrt(ratio) * F.sin(angle)
    one = F.col("n") == 1
    return _numbered(nodes.select("node")).select("node", F.when(one, 0.5).otherwise(x).alias("x"), F.when(one, 0.5).otherwise(y).alias("y"))


def layout_circle(nodes: DataFrame, start: float = math.pi / 2, clockwise: bool = True) -> DataFrame:
    return layout_oval(nodes, 1.0, start, clockwise)


def layout_grid(nodes: DataFrame, columns: int | None = None) -> DataFrame:
    """(node, x, y) in rows of `columns` (the ceiling of sqrt(n)), spread over the rows that there are; one node stands in the middle."""
    wide = F.lit(columns) if columns else F.ceil(F.sqrt("n"))
    high, one = F.ceil(F.col("n") / wide), F.col("n") == 1
    x, y = 0.1 + 0.8 * (F.col("i") % wide) / F.greatest(wide - 1, F.lit(1)), 0.9 - 0.8 * F.floor(F.col("i") / wide) / F.greatest(high - 1, F.lit(1))
    return _numbered(nodes.select("node")).select("node", F.when(one, 0.5).otherwise(x).alias("x"), F.when(one, 0.5).otherwise(y).alias("y"))


def layout_star(nodes: DataFrame, center=None) -> DataFrame:
    """(node, x, y): one node (the first by name) in the middle, the others counter-clockwise about it."""
    ranked = cut(_numbered(nodes.select("node")))
    at = ranked.filter(F.col("node") == center if center is not None else F.col("i") == 0).select(F.col("i").alias("at")).limit(1)
    ranked = ranked.join(F.broadcast(at), F.lit(True), "left").withColumn("mid", F.col("i").eqNullSafe(F.col("at")))
    place = F.when(F.col("i") > F.col("at"), F.col("i") - 1).otherwise(F.col("i"))
    angle = math.pi / 2 + 2 * math.pi * place / (F.col("n") - 1)
    return ranked.select("node", F.when(F.col("mid"), 0.5).otherwise(0.5 + 0.4 * F.cos(angle)).alias("x"), F.when(F.col("mid"), 0.5).otherwise(0.5 + 0.4 * F.sin(angle)).alias("y"))


def layout_bipartite(nodes: DataFrame, types: str | None = None) -> DataFrame:
    """(node, x, y): nodes of the first node's type (every second node, without a column of types) on the left, the others on the right."""
    ranked = nodes.select("node", F.col(types).alias("type") if types else F.lit(None).cast("string").alias("type"))
    if types:
        first = F.broadcast(ranked.agg(F.min_by("type", "node").alias("first")))  # one row
        ranked = ranked.join(first, how="cross").withColumn("left", F.col("type").eqNullSafe(F.col("first")))
    else:
        ranked = _numbered(ranked).withColumn("left", F.col("i") % 2 == 0)
    # Places on a side are places among all of it, less those before on the other one.
    ranked = running(ranked.select("node", "left", F.col("left").cast("int").alias("one")), ["node"], name="i")
    ranked = running(ranked, ["node"], "one", "l")
    totals = F.broadcast(ranked.agg(F.sum("one").alias("ln"), F.count("*").alias("all")))
    ranked = ranked.join(totals, how="cross")
    at = F.when(F.col("left"), F.col("l") - 1).otherwise(F.col("i") - F.col("l") - 1)
    n = F.when(F.col("left"), F.col("ln")).otherwise(F.col("all") - F.col("ln"))
    return ranked.select("node", F.when(F.col("left"), 0.2).otherwise(0.8).alias("x"), (0.9 - 0.8 * at / F.greatest(n - 1, F.lit(1))).alias("y"))


def layout_random(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """(node, x, y) spread evenly over 0.1 .. 0.9 by a hash of the node, so that reruns agree."""
    part = lambda s: 0.1 + 0.8 * F.pmod(F.xxhash64("node", F.lit(seed + s)), F.lit(1 << 30)) / float(1 << 30)
    return nodes.select("node", part(0).alias("x"), part(1).alias("y"))


def layout_sphere(nodes: DataFrame) -> DataFrame:
    """(node, x, y, z) on a sphere, along a spiral from pole to pole."""
    at = _numbered(nodes.select("node"))
    height = F.when(F.col("n") > 1, -1 + 2 * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(-1.0)
    at = at.withColumn("z", height).withColumn("r", F.sqrt(F.greatest(1 - F.col("z") * F.col("z"), F.lit(0.0))))
    turn = F.when((F.col("i") > 0) & (F.col("i") < F.col("n") - 1), 3.6 / F.sqrt(F.col("n") * F.col("r") * F.col("r"))).otherwise(0.0)
    at = running(at.withColumn("turn", turn), ["i"], "turn", "angle")
    return at.select("node", (F.col("r") * F.cos("angle")).alias("x"), (F.col("r") * F.sin("angle")).alias("y"), "z")


def layout_tree(net) -> DataFrame:
    """(node, x, y): breadth-first trees from each component's least node, side by side, roots on top.

    Leaves stand one apart, in the order in which the tree numbers them; a parent stands in
    the middle between its first and last leaf. A node without edges is a tree of its own.
    """
    forest = net.nodes.select("node").join(spanning_forest(net), "node", "left")
    roots = connected_components(net.simple())
    at = forest.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("tree"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("pre", F.lit(0)).alias("pre"), F.coalesce("size", F.lit(1)).alias("size"))
    at = cut(at.withColumn("leaf", (F.col("size") == 1).cast("long")))
    upto = running(at, ["tree", "pre"], "leaf", "leaves")  # leaves up to a node, of all trees before too
    last = upto.select("tree", (F.col("pre") + 1).alias("end"), F.col("leaves").alias("last"))
    spans = upto.join(last, (upto["tree"] == last["tree"]) & (F.col("pre") + F.col("size") == F.col("end")), "inner").select("node", "depth", "leaf", "leaves", "last")
    first = F.col("leaves") + 1 - F.col("leaf")
    return spans.select("node", ((first + F.col("last")) / 2).alias("x"), (-F.col("depth")).cast("double").alias("y"))


def layout_groups(membership: DataFrame, inner: float = 0.15, outer: float = 0.35) -> DataFrame:
    """(node, x, y): groups counter-clockwise on a circle (a single one in the middle), members likewise about them."""
    groups = _numbered(membership.select(F.col("cluster").alias("node")).distinct())
    angle = math.pi / 2 + 2 * math.pi * F.col("i") / F.col("n")
    off = F.when(F.col("n") == 1, 0.0).otherwise(outer)
    centres = groups.select(F.col("node").alias("cluster"), (0.5 + off * F.cos(angle)).alias("cx"), (0.5 + off * F.sin(angle)).alias("cy"))
    inside = _numbered(membership.select("node", "cluster"), "cluster").join(centres, "cluster")
    around = math.pi / 2 + 2 * math.pi * F.col("i") / F.col("n")
    away = F.when(F.col("n") == 1, 0.0).otherwise(inner)
    return inside.select("node", (F.col("cx") + away * F.cos(around)).alias("x"), (F.col("cy") + away * F.sin(around)).alias("y"))


def _spans(coords: DataFrame) -> DataFrame:
    """coords beside one row of the least and largest x and y."""
    return coords.join(F.broadcast(coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))), how="cross")


def rescale(coords: DataFrame, margin: float = 0.1) -> DataFrame:
    """Both axes by one factor about the middle of their ranges, the larger range onto twice 1 - margin; an axis without spread counts as 2 wide."""
    wide = lambda c: F.when(F.col(f"{c}1") - F.col(f"{c}0") < 1e-10, 2.0).otherwise(F.col(f"{c}1") - F.col(f"{c}0"))
    axis = lambda c: (F.col(c) - (F.col(f"{c}1") + F.col(f"{c}0")) / 2) / F.greatest(wide("x"), wide("y")) * 2 * (1 - margin)
    return _spans(coords).select(*[c for c in coords.columns if c not in ("x", "y")], axis("x").alias("x"), axis("y").alias("y"))


def normalize(coords: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Each axis from its least to its largest value onto low .. high; an axis without spread to the middle."""
    axis = lambda c: F.coalesce(low + (high - low) * F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")), F.lit((low + high) / 2))
    return _spans(coords).select(*[c for c in coords.columns if c not in ("x", "y")], axis("x").alias("x"), axis("y").alias("y"))


def _of_nodes(made):
    return lambda net, **options: made(net.nodes, **options)


#: Layouts by name, each (nodes, ..) -> (node, x, y); `register` adds more.
LAYOUTS = {"circle": layout_circle, "oval": layout_oval, "ellipse": layout_oval, "grid": layout_grid, "star": layout_star, "bipartite": layout_bipartite, "random": layout_random, "groups": layout_groups, "spring": layout_spring, "fr": layout_spring, "gephi_fr": layout_gephi_fr}

#: Layouts of a network by two letters; they end between 0.1 and 0.9. "ni" picks the spring layout, which has cells for large networks.
CODES = {
    "kk": layout_kamada_kawai, "fr": layout_spring, "mds": layout_mds, "tr": layout_tree, "ni": layout_spring,
    "st": _of_nodes(layout_star), "gr": _of_nodes(layout_grid), "rd": _of_nodes(layout_random), "sp": _of_nodes(layout_sphere), "ci": _of_nodes(layout_circle),
}


def by_code(net, code: str, **options) -> DataFrame:
    """(node, x, y): the layout of that code, each axis from 0.1 to 0.9, a single node in the middle."""
    if code not in CODES:
        raise ValueError(f"unknown layout: {code}; there are {', '.join(sorted(CODES))}")
    return normalize(CODES[code](net, **options).select("node", "x", "y"))


def register(name: str, made) -> None:
    """Adds a layout under a name; it replaces an older one."""
    if not callable(made):
        raise TypeError("a layout is a function of nodes")
    LAYOUTS[name] = made


def get(name: str):
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout: {name}")
    return LAYOUTS[name]


def names() -> list[str]:
    return sorted(LAYOUTS)
