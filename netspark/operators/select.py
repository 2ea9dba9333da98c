"""Selection of nodes and edges by columns and by measures computed only where a predicate names them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from . import degree, local, paths, spectral, structure

#: Measures that node predicates may name, each (node, value); computed on demand.
NODE_METRICS: dict[str, Callable[[Network], DataFrame]] = {
    "degree": degree.degree,
    "indegree": lambda n: degree.degree(n, "in", "indegree"),
    "outdegree": lambda n: degree.degree(n, "out", "outdegree"),
    "strength": degree.strength,
    "instrength": lambda n: degree.strength(n, "in", "instrength"),
    "outstrength": lambda n: degree.strength(n, "out", "outstrength"),
    "betweenness": paths.betweenness,
    "closeness": paths.closeness,
    "harmonic": paths.harmonic,
    "eigenvector": spectral.eigenvector,
    "pagerank": spectral.pagerank,
    "hub": lambda n: spectral.hits(n).select("node", "hub"),
    "authority": lambda n: spectral.hits(n).select("node", "authority"),
    "coreness": structure.coreness,
    "k_core": lambda n: structure.coreness(n).withColumnRenamed("coreness", "k_core"),
    "transitivity": local.transitivity_local,
    "component": structure.components,
    "component_size": lambda n: _component_size(n).select("node", "component_size"),
    "is_largest_component": lambda n: _component_size(n).select("node", "is_largest_component"),
    "neighborhood_size": lambda n: degree.degree(n, "all", "neighborhood_size"),
    "is_articulation": lambda n: _flag(n, structure.cut_vertices(n), "is_articulation"),
    "is_bridge_endpoint": lambda n: _flag(n, structure.bridges(n).select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "is_bridge_endpoint"),
}


def _component_size(net: Network) -> DataFrame:
    of = structure.components(net)
    sizes = of.groupBy("component").agg(F.count("*").alias("component_size"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.desc("component_size"), "component")))
    return of.join(ranked, "component").select("node", "component_size", (F.col("r") == 1).alias("is_largest_component"))


def _flag(net: Network, found: DataFrame, name: str) -> DataFrame:
    return net.nodes.select("node").join(found.select("node", F.lit(True).alias(name)), "node", "left").select("node", F.coalesce(name, F.lit(False)).alias(name))


def named_in(predicate: str, names) -> list[str]:
    """The names that stand in a SQL predicate, outside its string literals."""
    bare = re.sub(r"'[^']*'", "", predicate)
    return [n for n in names if re.search(rf"\b{n}\b", bare)]


def with_metrics(net: Network, names: list[str]) -> DataFrame:
    """Nodes with these measures; those that are columns already are left alone."""
    nodes = net.nodes
    for name in names:
        if name not in nodes.columns:
            nodes = nodes.join(NODE_METRICS[name](net), "node", "left")
    return nodes


def filter_nodes(net: Network, *predicates: str, keep_edges: bool = True) -> Network:
    """The network of the nodes for which all SQL predicates hold; null counts as false."""
    wide = with_metrics(net, named_in(" ".join(predicates), NODE_METRICS))
    for p in predicates:
        wide = wide.filter(F.coalesce(F.expr(p), F.lit(False)))
    return net.with_nodes(wide.select(*net.nodes.columns), keep_edges)


def select_nodes(net: Network, *predicates: str, name: list | None = None, index: list[int] | None = None, top: int | None = None, by: str = "degree", neighbors_of: list | None = None, order: int = 1, component=None, keep_edges: bool = True) -> Network:
    """Name, index (from 1, in the order of the nodes), component, neighbours, top and predicates, one after the other on what is left.

    Measures are those of the whole network; ties of `top` go by node.
    component: "largest" or a node.
    """
    nodes = net.nodes
    if name is not None:
        nodes = nodes.filter(F.col("node").isin(list(name)))
    if index is not None:
        numbered = net.nodes.select("node").withColumn("__i", F.row_number().over(Window.orderBy("node")))
        nodes = nodes.join(numbered.filter(F.col("__i").isin(list(index))).select("node"), "node", "left_semi")
    if component is not None:
        if component == "largest":
            inside = structure.largest_component(net).nodes
        else:
            of = structure.components(net)
            inside = of.join(of.filter(F.col("node") == component).select("component"), "component", "left_semi")
        nodes = nodes.join(inside.select("node"), "node", "left_semi")
    if neighbors_of is not None:
        nodes = nodes.join(paths.within(net, neighbors_of, order).select("node"), "node", "left_semi")
    if top is not None:
        metric = by if by in NODE_METRICS else "degree"
        ranked = nodes.select("node").join(NODE_METRICS[metric](net), "node", "left").orderBy(F.col(metric).desc_nulls_last(), "node").limit(top)
        nodes = nodes.join(ranked.select("node"), "node", "left_semi")
    chosen = net.with_nodes(nodes, keep_edges)
    if predicates:
        wide = with_metrics(net, named_in(" ".join(predicates), NODE_METRICS)).join(nodes.select("node"), "node", "left_semi")
        for p in predicates:
            wide = wide.filter(F.coalesce(F.expr(p), F.lit(False)))
        chosen = net.with_nodes(wide.select(*net.nodes.columns), keep_edges)
    return chosen


def _end(edges: DataFrame, metric: DataFrame, value: str, side: str) -> DataFrame:
    """Edges with a node's value at one end, as from_ or to_."""
    key = {"from": "src", "to": "dst"}[side]
    return edges.join(metric.select(F.col("node").alias(key), F.col(value).alias(f"{side}_{value}")), key, "left")


def _ends(edges: DataFrame, metric: DataFrame, value: str) -> DataFrame:
    src, dst = metric.select(F.col("node").alias("src"), F.col(value).alias(f"from_{value}")), metric.select(F.col("node").alias("dst"), F.col(value).alias(f"to_{value}"))
    return edges.join(src, "src", "left").join(dst, "dst", "left")


def _pair_flag(edges: DataFrame, found: DataFrame, name: str) -> DataFrame:
    marked = found.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.lit(True).alias(name)).distinct()
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.join(marked, (a == F.col("__a")) & (b == F.col("__b")), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("__a", "__b")


def _mutual(net: Network, edges: DataFrame) -> DataFrame:
    if not net.directed:
        return edges.withColumn("is_mutual", F.lit(True))
    back = net.edges.select(F.col("dst").alias("__s"), F.col("src").alias("__d"), F.lit(True).alias("is_mutual")).distinct()
    return edges.join(back, (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")), "left").withColumn("is_mutual", F.coalesce("is_mutual", F.lit(False))).drop("__s", "__d")


def _edge_betweenness(net: Network, edges: DataFrame) -> DataFrame:
    found = paths.edge_betweenness(net).select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("betweenness").alias("edge_betweenness"))
    a, b = (F.col("src"), F.col("dst")) if net.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.join(found, (a == F.col("__s")) & (b == F.col("__d")), "left").drop("__s", "__d")


def _same_community(net: Network, edges: DataFrame) -> DataFrame:
    from .community import louvain

    wide = _ends(edges, louvain(net), "community")
    return wide.withColumn("same_community", F.col("from_community") == F.col("to_community")).drop("from_community", "to_community")


#: Columns that edge predicates may name, each computed on demand.
EDGE_METRICS: dict[str, Callable[[Network, DataFrame], DataFrame]] = {
    "abs_weight": lambda n, e: e.withColumn("abs_weight", F.abs("weight")),
    "from_degree": lambda n, e: _end(e, degree.degree(n), "degree", "from"),
    "to_degree": lambda n, e: _end(e, degree.degree(n), "degree", "to"),
    "from_strength": lambda n, e: _end(e, degree.strength(n), "strength", "from"),
    "to_strength": lambda n, e: _end(e, degree.strength(n), "strength", "to"),
    "edge_betweenness": _edge_betweenness,
    "from_label": lambda n, e: e.withColumn("from_label", F.col("src")),
    "to_label": lambda n, e: e.withColumn("to_label", F.col("dst")),
    "is_bridge": lambda n, e: _pair_flag(e, structure.bridges(n), "is_bridge"),
    "is_mutual": _mutual,
    "same_community": _same_community,
}


def filter_edges(net: Network, *predicates: str, keep_isolates: bool = False) -> Network:
    """Edges for which all SQL predicates hold; null counts as false. Isolated nodes go unless kept."""
    return select_edges(net, *predicates, keep_isolates=keep_isolates)


def select_edges(net: Network, *predicates: str, top: int | None = None, by: str = "weight", involving: list | None = None, between: tuple[list, list] | None = None, bridges_only: bool = False, mutual_only: bool = False, keep_isolates: bool = False) -> Network:
    """Involving, between, bridges, mutual, top and predicates, one after the other; ties of `top` go by ends."""
    edges = net.edges
    if involving is not None:
        edges = edges.filter(F.col("src").isin(list(involving)) | F.col("dst").isin(list(involving)))
    if between is not None:
        a, b = (list(x) for x in between)
        edges = edges.filter((F.col("src").isin(a) & F.col("dst").isin(b)) | (F.col("src").isin(b) & F.col("dst").isin(a)))
    if bridges_only:
        edges = EDGE_METRICS["is_bridge"](net, edges).filter("is_bridge").drop("is_bridge")
    if mutual_only:
        edges = _mutual(net, edges).filter("is_mutual").drop("is_mutual")
    if top is not None:
        wide = EDGE_METRICS[by](net, edges) if by in EDGE_METRICS else edges
        edges = wide.orderBy(F.col(by if by in wide.columns else "weight").desc_nulls_last(), "src", "dst").limit(top).select(*net.edges.columns)
    wide = edges
    for name in named_in(" ".join(predicates), EDGE_METRICS):
        if name not in wide.columns:
            wide = EDGE_METRICS[name](net, wide)
    for p in predicates:
        wide = wide.filter(F.coalesce(F.expr(p), F.lit(False)))
    return net.with_edges(wide.select(*net.edges.columns), keep_isolates)
