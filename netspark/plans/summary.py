"""Plans that put several measures together, computing only what is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network, simplify
from ..functions import colors, scales
from ..operators import cluster, community, connectivity, degree, flow, local, paths, spectral, structure
from ..operators.select import NODE_METRICS
from ..session import cut

#: Measures of `centrality` beside those that selections may name.
MORE = {
    "eccentricity": paths.eccentricity, "kreach": paths.kreach, "load": paths.load, "percolation": paths.percolation, "diffusion": degree.diffusion, "leverage": degree.leverage,
    "voterank": degree.voterank, "current_flow_closeness": flow.current_flow_closeness, "current_flow_betweenness": flow.current_flow_betweenness,
    "laplacian": degree.laplacian, "constraint": local.constraint, "alpha": spectral.alpha_centrality, "power": spectral.power_centrality, "subgraph": spectral.subgraph_centrality,
}
MEASURES = {**NODE_METRICS, **MORE}


#: Which options of `centrality` a measure takes, by the names of its own function's parameters.
_OPTIONS = {
    **dict.fromkeys(("closeness", "harmonic", "eccentricity"), ("mode", "weighted", "cutoff", "invert", "alpha")), "betweenness": ("weighted", "cutoff", "invert", "alpha"),
    "kreach": ("mode", "weighted", "k"), **dict.fromkeys(("degree", "strength", "diffusion", "leverage"), ("mode",)), **dict.fromkeys(("load", "percolation", "eigenvector"), ("weighted",)),
    "pagerank": ("weighted", "damping", "personalized"), **dict.fromkeys(("current_flow_closeness", "current_flow_betweenness"), ("weighted",)), "alpha": ("weighted",), "power": ("weighted",),
}


def centrality(
    net: Network, measures: list[str], normalized: bool = False, loops: bool = True, method: str = "sum", digits: int | None = None, sort_by: str | None = None,
    mode: str | None = None, weighted: bool | None = None, cutoff: float | None = None, invert: bool | None = None, alpha: float = 1.0, damping: float = 0.85, personalized: DataFrame | None = None, k: float = 3,
) -> DataFrame:
    """(node, one column a measure); parallel edges merge first; normalized divides by the largest (closeness aside).

    Measures take what applies to them: mode (in, out, all) of degrees and distances;
    weighted; cutoff of path lengths; invert, with which paths have the lengths
    1 / weight^alpha; damping and personalized of pagerank; k of kreach. What is None
    stays as the measure has it by itself; invert is then true for models of transitions,
    whose nodes have an `init`.
    """
    unknown = [m for m in measures if m not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures: {', '.join(unknown)}")
    if mode not in (None, "in", "out", "all"):
        raise ValueError("a mode is in, out or all")
    flat = simplify(net, method, loops)
    flat = Network(cut(flat.nodes), cut(flat.edges), flat.directed, flat.meta)
    invert = "init" in net.nodes.columns if invert is None else invert
    told = {"mode": mode, "weighted": weighted, "cutoff": cutoff, "invert": invert or None, "alpha": alpha if invert else None, "damping": damping, "personalized": personalized, "k": k}
    taken = lambda m: {o: told[o] for o in _OPTIONS.get(m, ()) if told[o] is not None}
    out = reduce(lambda a, b: a.join(b, "node", "left"), [MEASURES[m](flat, **taken(m)) for m in measures], flat.nodes.select("node"))
    if normalized:
        top = out.agg(*[F.max(m).alias(f"top_{m}") for m in measures if m != "closeness"])
        out = out.join(top, how="cross").select("node", *[(F.col(m) if m == "closeness" else F.try_divide(m, f"top_{m}")).alias(m) for m in measures])
    if digits is not None:
        out = out.select("node", *[F.round(m, digits).alias(m) for m in measures])
    return out.orderBy(F.col(sort_by).desc_nulls_last(), "node") if sort_by else out


def edge_centrality(net: Network, measures: list[str] | None = None, weighted: bool = True, cutoff: float | None = None, invert: bool = False, alpha: float = 1.0, digits: int | None = None, sort_by: str | None = None) -> DataFrame:
    """(src, dst, weight, betweenness) of the edges, each with itself as often as it stands there; unweighted ones weigh 1.

    betweenness takes weights as lengths, or 1 / weight^alpha with `invert`; edges that stand more than once each show their pair's, loops have 0.
    """
    measures = measures or ["weight", "betweenness"]
    if unknown := set(measures) - {"weight", "betweenness"}:
        raise ValueError(f"unknown edge measures: {', '.join(sorted(unknown))}")
    out = net.edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("weight"))
    if "betweenness" in measures:
        found = paths.edge_betweenness(net, weighted, invert, cutoff, alpha).select(F.col("src").alias("__a"), F.col("dst").alias("__b"), "betweenness")
        ends = (F.col("src"), F.col("dst")) if net.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        out = out.join(found, (ends[0] == F.col("__a")) & (ends[1] == F.col("__b")), "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    out = out.select("src", "dst", *[(F.round(m, digits) if digits is not None else F.col(m)).alias(m) for m in measures])
    return out.orderBy(F.desc(sort_by), "src", "dst") if sort_by else out


def node_sizes(net: Network, measure: str, low: float = 2.0, high: float = 8.0) -> DataFrame:
    """(node, value, size): a measure and its place between the sizes; nodes without one count as 0, all alike take the middle."""
    found = centrality(net, [measure])
    value = F.coalesce(F.nanvl(F.col(measure).cast("double"), F.lit(0.0)), F.lit(0.0))
    return scales.scale_size(found.select("node", value.alias("value")), "value", low, high)


def community_colors(net: Network, method: str = "louvain", palette: list[str] | None = None) -> DataFrame:
    """(node, community, color): communities in their order take the colours of the palette."""
    return colors.color_levels(cut(community.communities(net, method)), "community", palette)


def _centralization(values: DataFrame, value: str, most, name: str) -> DataFrame:
    """Sum of distances from the largest value over the most that it can be, a function of n."""
    found = values.agg(F.count("*").cast("double").alias("n"), F.max(value).alias("top"), F.sum(value).alias("s"))
    return found.select(F.try_divide(F.col("n") * F.col("top") - F.col("s"), most(F.col("n"))).alias(name))


def network_summary(net: Network, weighted: bool = True, detailed: bool = False, extended: bool = False, mode: str = "all", loops: bool = True, method: str | None = "sum", digits: int | None = None) -> DataFrame:
    """One row: counts, distances, centralizations, and the measures of the whole network.

    mode (in, out, all) is that of the closeness and of the degrees of `detailed`;
    loops=False leaves loops out, method says how parallel edges merge (None: they stay);
    digits rounds what is not a count.

    extended adds girth, radius, clique size, cut vertices, bridges and efficiencies;
    detailed adds means of the nodes' measures.
    """
    if mode not in ("in", "out", "all"):
        raise ValueError("a mode is in, out or all")
    flat = net if method is None else simplify(net, method)
    edges = flat.edges if loops else flat.edges.filter("src <> dst")
    flat = Network(cut(flat.nodes), cut(edges.select("src", "dst", "weight")), flat.directed, flat.meta)
    directed = flat.directed
    path = cut(paths.path_summary(flat, weighted))
    none = lambda name: flat.nodes.agg(F.lit(None).cast("double").alias(name))
    side = lambda mode: degree.centralization_degree(flat, mode).withColumnRenamed("centralization", f"centralization_{mode}_degree") if directed else none(f"centralization_{mode}_degree")
    close = paths.closeness(flat, mode, normalized=True).select(F.coalesce(F.nanvl("closeness", F.lit(0.0)), F.lit(0.0)).alias("c"))
    hub = spectral.hits_value(flat, weighted).select(F.col("value").alias("hub_score"), F.col("value").alias("authority_score"))
    parts = [
        flat.nodes.agg(F.count("*").alias("node_count")), flat.edges.agg(F.count("*").alias("edge_count")), degree.density(flat), structure.components(flat).agg(F.countDistinct("component").alias("component_count")),
        path.select("diameter", "mean_distance"), connectivity.min_cut(flat), degree.centralization_degree(flat).withColumnRenamed("centralization", "centralization_degree"), side("in"), side("out"),
        _centralization(paths.betweenness(flat), "betweenness", lambda n: (n - 1) * (n - 1) * (n - 2) / (1 if directed else 2), "centralization_betweenness"),
        _centralization(close, "c", lambda n: (n - 1) * (n - 2) / (2 * n - 3), "centralization_closeness"),
        _centralization(spectral.eigenvector(flat, weighted=False), "eigenvector", lambda n: n - (1 if directed else 2), "centralization_eigen"),
        local.transitivity_global(flat), degree.reciprocity(flat) if directed else none("reciprocity"), degree.assortativity(flat).withColumnRenamed("assortativity", "assortativity_degree"), hub,
    ]
    if extended:
        parts += [
            paths.girth(flat), path.select("radius"), connectivity.vertex_connectivity(flat), local.clique_size(flat).withColumnRenamed("clique_size", "largest_clique_size"), structure.cut_vertices(flat).agg(F.count("*").alias("cut_vertex_count")),
            structure.bridges(flat).agg(F.count("*").alias("bridge_count")), path.select("global_efficiency"), paths.local_efficiency(flat).agg(F.avg("efficiency").alias("local_efficiency")),
        ]
    if detailed:
        mean = lambda df, column, name: df.agg(F.avg(F.when(~F.isnan(F.col(column).cast("double")), F.col(column))).alias(f"mean_{name}"))
        parts += [
            degree.degree(flat, mode).agg(F.avg("degree").alias("mean_degree"), F.stddev_samp("degree").alias("sd_degree"), F.median("degree").alias("median_degree")), degree.strength(flat, mode).agg(F.avg("strength").alias("mean_strength"), F.stddev_samp("strength").alias("sd_strength")),
            mean(paths.betweenness(flat, weighted), "betweenness", "betweenness"), mean(paths.closeness(flat, mode, weighted=weighted), "closeness", "closeness"), mean(spectral.eigenvector(flat, weighted), "eigenvector", "eigenvector"),
            mean(spectral.pagerank(flat, weighted=weighted), "pagerank", "pagerank"), mean(local.constraint(flat), "constraint", "constraint"), mean(local.transitivity_local(flat), "transitivity", "local_transitivity"),
        ]
    made = reduce(lambda a, b: a.join(b, how="cross"), parts)
    return made if digits is None else made.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


def partition_summary(net: Network, membership: DataFrame) -> DataFrame:
    """One row: modularity, coverage and the number of clusters."""
    return cluster.modularity(net, membership).join(cluster.coverage(net, membership), how="cross").join(membership.agg(F.countDistinct("cluster").alias("clusters")), how="cross")
