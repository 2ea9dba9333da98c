"""Components and cores; bridges and cut vertices come from `blocks`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from .blocks import bridges, cut_vertices  # noqa: F401
from .components import connected_components


def components(net: Network) -> DataFrame:
    """(node, component): weak components, named by their least node."""
    found = connected_components(net.edges)
    return net.nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(net: Network) -> DataFrame:
    return components(net).groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(net: Network) -> Network:
    """The network of the largest component; of equal ones, that with the least name."""
    of = cut(components(net))
    best = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return net.with_nodes(net.nodes.join(of.join(best, "component", "left_semi"), "node", "left_semi"))


def coreness(net: Network, most_rounds: int = 10_000) -> DataFrame:
    """(node, coreness) of the simple undirected network: each node takes the h-index of its neighbours' values until none falls.

    Neighbours are counted by value first, so a hub costs a row for each different value around it.
    """
    around = cut(net.around())
    core = cut(around.groupBy("node").agg(F.count("*").alias("core")))
    for _ in range(most_rounds):
        theirs = around.join(core.select(F.col("node").alias("other"), F.col("core").alias("c")), "other").groupBy("node", "c").agg(F.count("*").alias("n"))
        upto = theirs.withColumn("r", F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("c"))))
        core = cut(upto.groupBy("node").agg(F.max(F.least("c", "r")).cast("long").alias("h")).join(core, "node").select("node", F.least("h", "core").alias("core"), (F.col("h") < F.col("core")).alias("fell")), core)
        if core.filter("fell").isEmpty():
            break
    else:
        raise RuntimeError("cores did not settle")
    return net.nodes.select("node").join(core, "node", "left").select("node", F.coalesce("core", F.lit(0)).cast("long").alias("coreness"))
