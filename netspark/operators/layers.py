"""Multilayer networks: one table (layer, src, dst, weight); absent cells are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from .degree import pearson


def _aligned(one: DataFrame, two: DataFrame) -> DataFrame:
    a, b = one.select("src", "dst", F.col("weight").alias("x")), two.select("src", "dst", F.col("weight").alias("y"))
    return a.join(b, ["src", "dst"], "full_outer").fillna(0.0, ["x", "y"])


def layer_similarity(one: DataFrame, two: DataFrame, n_nodes: int) -> DataFrame:
    """One row: jaccard, overlap, hamming on edges above 0; cosine and pearson on all n^2 cells, from sums over the filled ones."""
    x, y = F.col("x"), F.col("y")
    s = _aligned(one, two).agg(
        F.count(F.when((x > 0) & (y > 0), 1)).alias("both"), F.count(F.when((x > 0) | (y > 0), 1)).alias("any"), F.count(F.when(x > 0, 1)).alias("nx"), F.count(F.when(y > 0, 1)).alias("ny"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
    )
    n = float(n_nodes) ** 2
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(
        F.try_divide("both", "any").alias("jaccard"), F.try_divide(F.col("both"), F.least("nx", "ny")).alias("overlap"), (F.col("any") - F.col("both")).alias("hamming"),
        F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("cosine"), F.when(spread > 0, F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread))).alias("pearson"),
    )


def layer_similarity_matrix(layers: DataFrame, n_nodes: int) -> DataFrame:
    """(layer_a, layer_b, jaccard, overlap, cosine, pearson) of all ordered pairs of layers, 1 with itself: as `layer_similarity`, from sums over the filled cells."""
    e = layers.groupBy("layer", "src", "dst").agg(F.sum("weight").alias("w"))
    up = (F.col("w") > 0).cast("long")
    own = e.groupBy("layer").agg(F.sum(up).alias("n"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    both = e.alias("a").join(e.alias("b"), (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst"))).groupBy(F.col("a.layer").alias("layer_a"), F.col("b.layer").alias("layer_b")).agg(F.sum(((F.col("a.w") > 0) & (F.col("b.w") > 0)).cast("long")).alias("both"), F.sum(F.col("a.w") * F.col("b.w")).alias("sxy"))
    a, b = [own.select(F.col("layer").alias(f"layer_{x}"), *[F.col(c).alias(f"{c}{x}") for c in "nsq"]) for x in "ab"]
    cells = float(n_nodes) ** 2
    pairs = a.join(b, how="cross").join(both, ["layer_a", "layer_b"], "left").fillna(0, ["both"]).fillna(0.0, ["sxy"])
    spread = (cells * F.col("qa") - F.col("sa") * F.col("sa")) * (cells * F.col("qb") - F.col("sb") * F.col("sb"))
    found = {
        "jaccard": F.try_divide(F.col("both"), F.col("na") + F.col("nb") - F.col("both")), "overlap": F.try_divide(F.col("both"), F.least("na", "nb")),
        "cosine": F.try_divide(F.col("sxy"), F.sqrt(F.col("qa") * F.col("qb"))), "pearson": F.when(spread > 0, F.try_divide(cells * F.col("sxy") - F.col("sa") * F.col("sb"), F.sqrt(spread))),
    }
    same = F.col("layer_a") == F.col("layer_b")
    return pairs.select("layer_a", "layer_b", *[F.when(same, 1.0).otherwise(v).alias(m) for m, v in found.items()])


def layer_degree_correlation(layers: DataFrame, nodes: DataFrame, mode: str = "total") -> DataFrame:
    """(layer_a, layer_b, correlation) of the nodes' strengths, absent ones 0."""
    out, into = layers.select("layer", F.col("src").alias("node"), "weight"), layers.select("layer", F.col("dst").alias("node"), "weight")
    ends = {"out": out, "in": into, "total": out.union(into)}[mode]
    grid = layers.select("layer").distinct().join(nodes.select("node"), how="cross")
    s = grid.join(ends.groupBy("layer", "node").agg(F.sum("weight").alias("s")), ["layer", "node"], "left").fillna(0.0, ["s"])
    return s.alias("a").join(s.alias("b"), F.col("a.node") == F.col("b.node")).groupBy(F.col("a.layer").alias("layer_a"), F.col("b.layer").alias("layer_b")).agg(pearson(F.col("a.s"), F.col("b.s")).alias("correlation"))


def supra_adjacency(layers: DataFrame, nodes: DataFrame, omega: float = 1.0, coupling: str | DataFrame = "diagonal") -> DataFrame:
    """(src_layer, src, dst_layer, dst, weight): the layers' edges and couplings between different layers: diagonal, full, or own (src, dst, weight) times omega."""
    intra = layers.select(F.col("layer").alias("src_layer"), "src", F.col("layer").alias("dst_layer"), "dst", F.col("weight").cast("double").alias("weight"))
    names = layers.select("layer").distinct()
    pairs = names.select(F.col("layer").alias("src_layer")).join(names.select(F.col("layer").alias("dst_layer")), F.col("src_layer") != F.col("dst_layer"))
    if isinstance(coupling, DataFrame):
        return intra.unionByName(pairs.join(coupling.select("src", "dst", (omega * F.col("weight")).alias("weight")), how="cross"))
    ends = nodes.select(F.col("node").alias("src"))
    ends = ends.withColumn("dst", F.col("src")) if coupling == "diagonal" else ends.join(nodes.select(F.col("node").alias("dst")), how="cross")
    return intra.unionByName(pairs.join(ends, how="cross").withColumn("weight", F.lit(float(omega))))


def supra_block(supra: DataFrame, src_layer, dst_layer=None) -> DataFrame:
    """(src, dst, weight) within a layer, or from one to another."""
    return supra.filter((F.col("src_layer") == src_layer) & (F.col("dst_layer") == (src_layer if dst_layer is None else dst_layer))).select("src", "dst", "weight")


def aggregate_layers(layers: DataFrame, method: str = "sum", weights: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): sum (weighted by (layer, factor)), mean, max, min with absent cells as 0; union and intersection of edges above 0."""
    if weights is not None:
        layers = layers.join(weights, "layer").withColumn("weight", F.col("weight") * F.col("factor"))
    count = layers.agg(F.countDistinct("layer").alias("l"))
    cells = layers.groupBy("src", "dst").agg(F.sum("weight").alias("s"), F.max("weight").alias("hi"), F.min("weight").alias("lo"), F.countDistinct("layer").alias("k"), F.countDistinct(F.when(F.col("weight") > 0, F.col("layer"))).alias("p")).join(count, how="cross")
    some = F.col("k") < F.col("l")
    value = {
        "sum": F.col("s"), "mean": F.col("s") / F.col("l"), "max": F.when(some, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")), "min": F.when(some, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")),
        "union": (F.col("p") > 0).cast("double"), "intersection": (F.col("p") == F.col("l")).cast("double"),
    }[method]
    return cells.select("src", "dst", value.cast("double").alias("weight")).filter("weight <> 0")


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """(src, dst, x, y, diff) of two networks over the same nodes."""
    return _aligned(one, two).withColumn("diff", F.col("x") - F.col("y"))


def differences(layers: DataFrame) -> DataFrame:
    """(layer_a, layer_b, src, dst, x, y, diff) of all pairs of layers, a before b, over the cells that either holds."""
    e = layers.groupBy("layer", "src", "dst").agg(F.sum("weight").alias("w"))
    names = e.select("layer").distinct()
    pairs = names.select(F.col("layer").alias("layer_a")).join(names.select(F.col("layer").alias("layer_b")), F.col("layer_a") < F.col("layer_b"))
    nothing = F.lit(0.0)
    one = pairs.join(e, F.col("layer_a") == F.col("layer")).select("layer_a", "layer_b", "src", "dst", F.col("w").alias("x"), nothing.alias("y"))
    two = pairs.join(e, F.col("layer_b") == F.col("layer")).select("layer_a", "layer_b", "src", "dst", nothing.alias("x"), F.col("w").alias("y"))
    return one.unionByName(two).groupBy("layer_a", "layer_b", "src", "dst").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).withColumn("diff", F.col("x") - F.col("y"))


def mixed(sym: DataFrame, asym: DataFrame) -> DataFrame:
    """(src, dst, weight, kind, mutual): undirected edges of one matrix's cells, each once, and directed ones of another's; mutual where the other way is there too."""
    one = sym.filter("weight <> 0 and src < dst").select("src", "dst", "weight", F.lit("undirected").alias("kind"), F.lit(False).alias("mutual"))
    arcs = asym.filter("weight <> 0 and src <> dst").select("src", "dst", "weight")
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual")).distinct()
    two = arcs.join(back, ["src", "dst"], "left").select("src", "dst", "weight", F.lit("directed").alias("kind"), F.coalesce("mutual", F.lit(False)).alias("mutual"))
    return one.unionByName(two)


def disparity(net: Network, level: float = 0.05) -> DataFrame:
    """(src, dst, weight, p, significant) of edges between different nodes: the backbone test by the lesser of the two ends' chances; loops count in strengths and degrees."""
    e = net.arcs()
    edges, total = F.count(F.when(F.col("weight") > 0, 1)), F.coalesce(F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0))
    out, into = e.groupBy("src").agg(edges.alias("ko"), total.alias("so")), e.groupBy("dst").agg(edges.alias("ki"), total.alias("si"))
    p = F.least(F.pow(1 - F.col("weight") / F.col("so"), F.col("ko") - 1), F.pow(1 - F.col("weight") / F.col("si"), F.col("ki") - 1))
    return e.filter("src <> dst and weight > 0").join(out, "src").join(into, "dst").select("src", "dst", "weight", p.alias("p")).withColumn("significant", F.col("p") < level)
