"""Fluid communities: k communities that grow from one node each and push one another about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from .community import _named
from .structure import largest_component


def fluid(net: Network, k: int, seed: int = 1, most_rounds: int = 1000) -> DataFrame:
    """(node, community): exactly k communities of the largest component (other nodes are left out); directions and weights do not count.

    A community of s nodes has the density 1 / s in each of them. A node takes the
    community whose densities in itself and around it sum highest, its own among equal
    ones. Nodes take turns in random halves, later in smaller parts, until none would
    change; where a turn would empty a community, its first node stays.
    """
    whole = largest_component(net)
    nodes, around = cut(whole.nodes.select("node")), cut(whole.around())
    if not 1 <= k <= nodes.count():
        raise ValueError("k is between 1 and the number of nodes of the largest component")
    seeds = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k).select(F.col("node").alias("s"))
    own = cut(nodes.join(seeds, F.col("node") == F.col("s"), "left").select("node", F.col("s").alias("c")))
    for i in range(most_rounds):
        size = own.filter("c is not null").groupBy("c").agg(F.count("*").alias("n"))
        told = own.filter("c is not null").join(size, "c").select("node", "c", (1.0 / F.col("n")).alias("density"))
        heard = around.join(told.withColumnRenamed("node", "other"), "other").select("node", "c", "density").union(told)
        sums = heard.groupBy("node", "c").agg(F.round(F.sum("density"), 9).alias("d")).join(own.select("node", F.col("c").alias("now")), "node")
        luck = F.xxhash64("node", "c", F.lit(seed + i))
        best = sums.groupBy("node").agg(F.max_by("c", F.struct("d", F.col("c").eqNullSafe(F.col("now")), luck)).alias("new"))
        parts = 2 + i // 8
        turn = F.pmod(F.xxhash64("node", F.lit(seed + i // parts)), F.lit(parts)) == i % parts
        wants = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("c"))
        asked = cut(own.join(best, "node", "left").select("node", "c", "new", wants.alias("wants"), (wants & turn).alias("goes")))
        emptied = asked.filter("c is not null").groupBy("c").agg(F.min("node").alias("stays"), F.min("goes").alias("all")).filter("all").select("stays")
        moved = asked.join(emptied, F.col("node") == F.col("stays"), "left")
        own = cut(moved.select("node", F.when(F.col("goes") & F.col("stays").isNull(), F.col("new")).otherwise(F.col("c")).alias("c")), own)
        if asked.filter("wants").isEmpty():
            return _named(own.select("node", F.col("c").alias("community")))
    raise RuntimeError("communities did not settle")
