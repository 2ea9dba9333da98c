"""Networks as two DataFrames: nodes (node, ..) and edges (src, dst, weight, ..)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names that an edge list may use, lower case.
SOURCES = ("from", "source", "src", "v1", "node1", "i")
TARGETS = ("to", "target", "tgt", "dst", "v2", "node2", "j")
WEIGHTS = ("weight", "w", "value", "strength")


@dataclass(frozen=True)
class Network:
    """Edges of an undirected network stand once each, in any order of their ends."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    meta: dict = field(default_factory=dict)

    def with_edges(self, edges: DataFrame, keep_isolates: bool = False) -> Network:
        ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        return replace(self, edges=edges, nodes=self.nodes if keep_isolates else self.nodes.join(ends, "node", "left_semi"))

    def with_nodes(self, nodes: DataFrame, keep_edges: bool = True) -> Network:
        """The network induced by these nodes (or its nodes alone)."""
        names = nodes.select("node")
        edges = self.edges.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*self.edges.columns)
        return replace(self, nodes=nodes, edges=edges if keep_edges else edges.limit(0))

    def arcs(self) -> DataFrame:
        """(src, dst, weight) in every direction that the network can be walked; loops once."""
        e = self.edges.select("src", "dst", "weight")
        return e if self.directed else e.union(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def simple(self) -> DataFrame:
        """(src, dst), src < dst: the distinct unordered pairs of different linked nodes."""
        return self.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def around(self) -> DataFrame:
        """(node, other): neighbours in either direction, each once, without the node itself."""
        s = self.simple()
        return s.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(s.select("dst", "src"))

    def set_groups(self, groups: DataFrame, kind: str = "group") -> Network:
        """The network with a group, cluster or layer of each node; groups (node, value) must know all nodes, once each."""
        if kind not in ("group", "cluster", "layer"):
            raise ValueError("a kind is group, cluster or layer")
        names, value = self.nodes.select("node"), next(c for c in groups.columns if c != "node")
        placed = groups.select("node", F.col(value).alias(kind))
        for bad, what in ((placed.groupBy("node").count().filter("count > 1"), "nodes placed twice"), (placed.join(names, "node", "left_anti"), "unknown nodes"), (names.join(placed, "node", "left_anti"), "nodes without a group")):
            if not bad.isEmpty():
                raise ValueError(what)
        return replace(self, meta={**self.meta, "groups": placed})

    def get_groups(self) -> DataFrame | None:
        return self.meta.get("groups")

    def set_nodes(self, nodes: DataFrame) -> Network:
        """The network with these nodes in place of its own; edges to others go."""
        return self.with_nodes(nodes)

    def set_edges(self, edges: DataFrame) -> Network:
        return replace(self, edges=edges)

    def n_nodes(self) -> int:
        return self.nodes.count()

    def n_edges(self) -> int:
        return self.edges.count()


def _named(df: DataFrame, names: tuple[str, ...], position: int | None) -> str | None:
    known = {c.lower(): c for c in reversed(df.columns)}
    return next((known[n] for n in names if n in known), df.columns[position] if position is not None else None)


def from_edges(df: DataFrame, src: str | None = None, dst: str | None = None, weight: str | None = None, directed: bool | None = None, nodes: DataFrame | None = None) -> Network:
    """A network from an edge list; columns by name, or the first two.

    Rows with a null end or weight 0 are no edges; a missing weight column is 1.
    With `directed=None` the list decides (`looks_directed`).
    """
    src, dst = src or _named(df, SOURCES, 0), dst or _named(df, TARGETS, 1)
    weight = weight or _named(df, WEIGHTS, None)
    edges = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), *[c for c in df.columns if c not in (src, dst, weight, "src", "dst", "weight")])
    edges = edges.filter("src is not null and dst is not null and weight <> 0")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    directed = looks_directed(edges) if directed is None else directed
    return Network(nodes if nodes is not None else ends, edges, directed)


def parse(data, nodes: DataFrame | None = None, directed: bool | None = None) -> Network:
    """A network from whatever holds one: a network itself, (nodes, edges), matrix cells or an edge list, or a wide square matrix (a label column, then one column for each label)."""
    if isinstance(data, Network):
        return data
    if isinstance(data, tuple):
        return from_edges(data[1], directed=directed, nodes=data[0])
    known = {c.lower() for c in data.columns}
    if known & set(SOURCES) and known & set(TARGETS) or len(data.columns) <= 2:
        return from_edges(data, directed=directed, nodes=nodes)
    label, rest = data.columns[0], set(data.columns[1:])
    if {str(r[0]) for r in data.select(label).limit(len(rest) + 1).collect()} == rest:  # as many rows as columns
        return from_matrix(from_wide(data, label), directed)
    return from_edges(data, directed=directed, nodes=nodes)


def from_model(edges: DataFrame, inits: DataFrame) -> Network:
    """A directed network of a transition model: edges (src, dst, weight) and initial states (state, share) as a column `init` of the nodes."""
    net = from_edges(edges, directed=True)
    names = net.nodes.select("node").union(inits.select("state")).distinct()
    first = inits.select(F.col("state").alias("node"), F.col(next(c for c in inits.columns if c != "state" and c != "count")).cast("double").alias("init"))
    return replace(net, nodes=names.join(first, "node", "left").fillna(0.0, ["init"]))


def looks_directed(edges: DataFrame) -> bool:
    """Whether an unordered pair repeats or an edge's reverse is there; a loop is its own reverse."""
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    return not pairs.filter("n > 1 or a = b").isEmpty()


def from_matrix(cells: DataFrame, directed: bool | None = None, tolerance: float = 1.49e-8) -> Network:
    """A network from matrix cells (src, dst, weight); symmetric ones are undirected, with the upper triangle alone."""
    cells = cells.filter("weight <> 0")
    if directed is None:
        directed = not is_symmetric(cells, tolerance)
    return from_edges(cells if directed else cells.filter("src < dst"), directed=directed, nodes=cells.select(F.col("src").alias("node")).union(cells.select("dst")).distinct())


def from_wide(matrix: DataFrame, label: str) -> DataFrame:
    """Cells of a square matrix whose columns are named like the labels of its rows."""
    return matrix.unpivot([label], [c for c in matrix.columns if c != label], "dst", "weight").withColumnRenamed(label, "src").filter("weight <> 0")


def is_symmetric(cells: DataFrame, tolerance: float = 1.49e-8) -> bool:
    """Mean relative difference between a matrix and its transpose within the tolerance."""
    other = cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    both = cells.select("src", "dst", "weight").join(other, ["src", "dst"], "full_outer").select(F.coalesce("weight", F.lit(0.0)).alias("x"), F.coalesce("back", F.lit(0.0)).alias("y"))
    row = both.filter("x <> y").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("d"), F.sum(F.abs("x")).alias("s")).first()
    return not row.d or (row.d / row.s if row.s else row.d) < tolerance


def undirected(net: Network) -> Network:
    """Mutual and repeated edges merge, weights add."""
    edges = net.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))
    return Network(net.nodes, edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), False, net.meta)


def directed(net: Network) -> Network:
    """Every undirected edge becomes a mutual pair."""
    return replace(net, edges=net.arcs(), directed=True)


REDUCERS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def simplify(net: Network, method: str = "sum", loops: bool = True) -> Network:
    """Parallel edges merge by sum, mean, max or min; loops go unless kept."""
    a, b = ("src", "dst") if net.directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = net.edges.groupBy(a, b).agg(REDUCERS[method]("weight").alias("weight"))
    return replace(net, edges=edges if loops else edges.filter("src <> dst"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Unordered pairs that stand more than once: a, b, count, weights (sorted)."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("count"), F.sort_array(F.collect_list("weight")).alias("weights")).filter("count > 1")


def merge_duplicates(edges: DataFrame, method="mean", order: Column | None = None) -> DataFrame:
    """Unordered pairs once: sum, mean, max, min, first by an order, or a function of the weight column that aggregates."""
    how = method(F.col("weight")) if callable(method) else F.min_by("weight", order) if method == "first" else REDUCERS[method]("weight")
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(how.alias("weight"))


def adjacency(net: Network) -> DataFrame:
    """All cells (src, dst, weight) of the adjacency matrix that are not zero."""
    return net.arcs().groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
