"""Bridges, cut vertices and blocks (biconnected components) from one spanning forest.

Every component gets a tree by breadth-first search and its nodes preorder numbers, so
the nodes below v are the numbers from pre(v) to pre(v) + size(v). The least and largest
number that the edges off the tree reach from below a node (low, high), gathered level
by level up the tree, tell whether something leads around its tree edge. All tables are
linear in nodes and edges, and each level of the tree is a job in each direction; so
this suits networks of any number of edges whose diameter is not in the thousands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut, discard
from .components import connected_components

#: A node's children are numbered in so many parts, so that a hub's are not sorted by one task.
PARTS = 64


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _levels(around: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """(node, parent) by distance from the roots; around: (node, other)."""
    levels = [cut(roots.select("node", F.lit(None).cast(roots.schema["node"].dataType).alias("parent")))]
    while True:
        # What a level touches lies on it, or one before or behind it.
        reached = around.join(levels[-1].select("node"), "node").groupBy("other").agg(F.min("node").alias("parent")).withColumnRenamed("other", "node")
        for known in levels[-2:]:
            reached = reached.join(known.select("node"), "node", "left_anti")
        found = cut(reached)
        if found.isEmpty():
            return levels
        levels.append(found)


def spanning_forest(net: Network) -> DataFrame:
    """(node, parent, depth, pre, size) of every node with an edge to another: breadth-first trees from each component's least node.

    pre numbers a tree's nodes from 0, each before what is below it; size counts a node and what is below it.
    """
    around = cut(net.around())
    trees = connected_components(net.simple())
    levels = _levels(around, trees.filter("node = component").select("node"))
    sizes, below = [], None
    for level in reversed(levels):
        if below is None:
            sized = level.withColumn("size", F.lit(1).cast("long"))
        else:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under"))
            sized = level.join(under, "node", "left").select("node", "parent", (1 + F.coalesce("under", F.lit(0))).alias("size"))
        below = cut(sized)
        sizes.append(below)
    sizes.reverse()
    placed = [cut(sizes[0].select("node", "parent", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pre"), "size"))]
    for depth, level in enumerate(sizes[1:], 1):
        parted = level.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
        parts = parted.groupBy("parent", "part").agg(F.sum("size").alias("sum"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.coalesce(F.sum("size").over(Window.partitionBy("parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        above = placed[-1].select(F.col("node").alias("parent"), F.col("pre").alias("top"))
        numbered = parted.withColumn("own", own).join(parts.withColumn("before", before).drop("sum"), ["parent", "part"]).join(above, "parent")
        placed.append(cut(numbered.select("node", "parent", F.lit(depth).alias("depth"), (F.col("top") + 1 + F.col("before") + F.col("own")).alias("pre"), "size")))
    forest = cut(_all(placed))
    discard(around, *levels, *sizes, *placed)
    return forest


def _reach(net: Network, forest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest with low and high, and the edges off the trees (u, v, pre_u, size_u, pre_v) with pre_u < pre_v."""
    u, v = (forest.select(F.col("node").alias(x), F.col("pre").alias(f"pre_{x}"), F.col("size").alias(f"size_{x}"), F.col("parent").alias(f"up_{x}")) for x in "uv")
    ends = net.simple().join(u, F.col("src") == F.col("u")).join(v, F.col("dst") == F.col("v"))
    off = ends.filter(~(F.col("up_u").eqNullSafe(F.col("v")) | F.col("up_v").eqNullSafe(F.col("u"))))
    first = F.col("pre_u") < F.col("pre_v")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    off = cut(off.select(pick("u", "v").alias("u"), pick("v", "u").alias("v"), pick("pre_u", "pre_v").alias("pre_u"), pick("size_u", "size_v").alias("size_u"), F.greatest("pre_u", "pre_v").alias("pre_v")))
    reached = off.select(F.col("u").alias("node"), F.col("pre_v").alias("at")).union(off.select("v", "pre_u")).groupBy("node").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    own = cut(forest.join(reached, "node", "left").select("node", "parent", "depth", "pre", "size", F.least("pre", "least").alias("low"), F.greatest("pre", "most").alias("high")))
    depth = own.agg(F.max("depth")).first()[0] or 0
    levels = []
    for d in range(depth, -1, -1):
        level = own.filter(F.col("depth") == d)
        if levels:
            under = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("least"), F.max("high").alias("most"))
            level = level.join(under, "node", "left").select("node", "parent", "depth", "pre", "size", F.least("low", "least").alias("low"), F.greatest("high", "most").alias("high"))
        levels.append(cut(level))
    return cut(_all(levels)), off


def blocks(net: Network) -> DataFrame:
    """(src, dst, block): the simple edges by biconnected component, which is named by one of its nodes.

    A block is a greatest set of edges of which any two lie on a common cycle. Tree edges,
    named by their lower ends, belong together if an edge off the tree joins two branches
    (its ends' tree edges), or leads from below one to beyond the tree edge above it.
    """
    forest, off = _reach(net, spanning_forest(net))
    of = _tree_blocks(forest, off)
    tree = of.filter("parent is not null").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"), "block")
    rest = off.join(of.select(F.col("node").alias("v"), "block"), "v").select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "block")
    return tree.union(rest)


def _tree_blocks(forest: DataFrame, off: DataFrame) -> DataFrame:
    """(node, parent, block) where the block is that of the edge to the parent; none for roots."""
    branches = off.filter("pre_u + size_u <= pre_v").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    above = forest.filter("parent is not null").select(F.col("node").alias("parent"), F.col("pre").alias("p"), F.col("size").alias("s"))
    along = forest.join(above, "parent").filter("low < p or high >= p + s").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    met = connected_components(branches.union(along))
    return cut(forest.join(met, "node", "left").select("node", "parent", F.when(F.col("parent").isNotNull(), F.coalesce("component", "node")).alias("block")))


def cut_vertices(net: Network) -> DataFrame:
    """Nodes whose removal leaves more components than there were: those in more than one block."""
    forest, off = _reach(net, spanning_forest(net))
    of = _tree_blocks(forest, off).filter("parent is not null")
    ends = of.select("node", "block").union(of.select("parent", "block"))
    return ends.groupBy("node").agg(F.countDistinct("block").alias("blocks")).filter("blocks > 1").select("node")


def bridges(net: Network) -> DataFrame:
    """(src, dst): edges whose removal leaves more components; parallel edges are no bridges."""
    forest, _ = _reach(net, spanning_forest(net))
    alone = forest.filter("parent is not null and low >= pre and high < pre + size").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    once = net.edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n")).filter("n = 1")
    return alone.join(once, ["src", "dst"], "left_semi")
