"""Connected components by alternating large-star and small-star passes.

Each pass is a grouped minimum joined back to its edges; every node ends up
linked to the least node of its component. Hubs are only ever aggregated (with
partial sums) or joined (a side that adaptive execution splits), never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

#: Networks with more edges than this are thinned first, to so many edges a node chosen by hash; the others are looked at once, to see what they add.
THIN, KEPT = 1_000_000, 4


def chosen_edges(pairs: DataFrame, a: str, b: str) -> DataFrame | None:
    """About KEPT edges a node of the distinct pairs, or None where thinning would save little."""
    size = pairs.agg(F.count("*").alias("n"), F.approx_count_distinct(a).alias("a"), F.approx_count_distinct(b).alias("b")).first()
    if size.n <= THIN or 2 * KEPT * max(size.a, size.b) > size.n:
        return None
    share = KEPT * max(size.a, size.b) / size.n
    return pairs.filter(F.pmod(F.xxhash64(a, b), F.lit(1 << 20)) < int(share * (1 << 20)))


def _thinned(at: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components: stars of what some edges link, and all edges between these."""
    some = chosen_edges(at, "u", "v")
    if some is None:
        return at
    of = cut(_stars(cut(some), 50).filter("node <> component"))
    labels = [of.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "uv"]
    across = at.join(labels[0], "u", "left").join(labels[1], "v", "left").filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v"))
    made = cut(of.select(F.col("node").alias("u"), F.col("component").alias("v")).union(across.select("u", "v")), at)
    discard(of)
    return made


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One pass over edges (u, v) with u > v."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        made = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        made = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return made.filter("u <> v")


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and none that is pointed to points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.filter("out + into > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its least node.

    Null ends and self-loops link nothing; repeated edges count once.
    """
    linked = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    at = linked.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    return _stars(_thinned(cut(at)), most_rounds)


def _stars(at: DataFrame, most_rounds: int) -> DataFrame:
    """(node, component) from edges (u, v) with u > v, stored."""
    for _ in range(most_rounds):
        if _stars_only(at):
            break
        at = cut(_star(_star(at, large=True), large=False).distinct(), at)
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v"), F.col("v")).distinct())
