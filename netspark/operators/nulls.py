"""Random networks to compare with: many at once, as one table of edges (run, src, dst).

Draws come from hashes of the run and a number, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from . import local, paths


def same_size(spark: SparkSession, n: int, m: int, runs: int = 10, seed: int = 1) -> DataFrame:
    """(run, src, dst), src < dst: m different pairs of the nodes 0 .. n - 1 a run, every choice equally likely.

    The first m different pairs of a long row of draws; where more than half of
    all pairs are wanted, those that are not drawn.
    """
    every = n * (n - 1) // 2
    if m > every:
        raise ValueError("more edges than pairs of nodes")
    few = min(m, every - m)
    draws = 4 * few + 200
    number = lambda part: F.pmod(F.xxhash64("run", "i", F.lit(seed), F.lit(part)), F.lit(n))
    drawn = spark.range(runs * draws).select((F.col("id") / draws).cast("long").alias("run"), (F.col("id") % draws).alias("i")).select("run", "i", number(0).alias("a"), number(1).alias("b")).filter("a <> b")
    pairs = drawn.groupBy("run", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("i").alias("i"))
    chosen = pairs.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy("i"))).filter(F.col("r") <= few).select("run", "src", "dst")
    if few == m:
        return chosen
    names = spark.range(n)
    whole = names.select(F.col("id").alias("src")).join(names.select(F.col("id").alias("dst")), F.col("src") < F.col("dst")).join(spark.range(runs).select(F.col("id").alias("run")), how="cross")
    return whole.join(chosen, ["run", "src", "dst"], "left_anti").select("run", "src", "dst")


def same_degrees(net: Network, runs: int = 10, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(run, src, dst), src < dst: the simple undirected network after rounds of swaps, with the degrees of all nodes.

    In a round the edges of a run meet in twos by chance and exchange an end each;
    not where that makes a loop, an edge that is there, or one that two make.
    """
    edges = cut(net.nodes.sparkSession.range(runs).select(F.col("id").alias("run")).join(net.simple(), how="cross"))
    for i in range(rounds):
        chance = lambda part: F.xxhash64("run", "src", "dst", F.lit(seed), F.lit(i), F.lit(part))  # noqa: B023, E731
        turned = edges.select("run", "src", "dst", (F.pmod(chance(0), F.lit(2)) == 0).alias("turn"), (F.row_number().over(Window.partitionBy("run").orderBy(chance(1), "src", "dst")) - 1).alias("r"))
        ends = turned.select("run", (F.col("r") / 2).cast("long").alias("two"), (F.col("r") % 2).alias("side"), F.when(F.col("turn"), F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(F.col("turn"), F.col("src")).otherwise(F.col("dst")).alias("b"))
        one, two = [ends.filter(F.col("side") == k).select("run", "two", F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")) for k in (0, 1)]
        met = cut(one.join(two, ["run", "two"]))
        pair = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
        new = met.select("run", "two", F.explode(F.array(pair("a0", "b1"), pair("a1", "b0"))).alias("e")).select("run", "two", "e.src", "e.dst")
        bad = new.filter("src = dst").select("run", "two").union(new.join(edges, ["run", "src", "dst"]).select("run", "two"))
        twice = new.withColumn("n", F.count("*").over(Window.partitionBy("run", "src", "dst"))).filter("n > 1").select("run", "two")
        good = met.select("run", "two").join(bad.union(twice).distinct(), ["run", "two"], "left_anti")
        old = met.join(good, ["run", "two"], "left_semi").select("run", F.explode(F.array(pair("a0", "b0"), pair("a1", "b1"))).alias("e")).select("run", "e.src", "e.dst")
        edges = cut(edges.join(old, ["run", "src", "dst"], "left_anti").unionByName(new.join(good, ["run", "two"], "left_semi").select("run", "src", "dst")), edges)
    return edges


def _closed_and_far(runs: DataFrame) -> DataFrame:
    """(run, c, l): share of closed triples and mean distance of linked nodes in each run."""
    end = lambda c: F.struct("run", F.col(c).alias("at"))
    edges = cut(runs.select(end("src").alias("src"), end("dst").alias("dst"), F.lit(1.0).alias("weight")))
    net = Network(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges, False)
    closed = local.triangles(net).groupBy(F.col("a.run").alias("run")).agg(F.count("*").alias("closed"))
    triples = net.around().groupBy("node").agg(F.count("*").alias("k")).groupBy("node.run").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("triples"))
    far = paths.distances(net).filter("source <> node").groupBy("source.run").agg(F.avg("dist").alias("l"))
    return far.join(triples, "run").join(closed, "run", "left").select("run", F.try_divide(3 * F.coalesce("closed", F.lit(0)), "triples").alias("c"), "l")


def small_world(net: Network, runs: int = 10, seed: int = 1) -> DataFrame:
    """(small_world): closed triples against networks of the same size, over mean distances against theirs.

    Null below four nodes, without edges, without closed triples here, or without any in the random ones.
    """
    spark = net.nodes.sparkSession
    edges = cut(net.simple())
    n, m = net.n_nodes(), edges.count()
    if n < 4 or m < 1:
        return spark.range(1).select(F.lit(None).cast("double").alias("small_world"))
    seen = _closed_and_far(edges.select(F.lit(0).cast("long").alias("run"), "src", "dst")).select(F.nullif("c", F.lit(0.0)).alias("c"), F.col("l"))
    by_chance = _closed_and_far(same_size(spark, n, m, runs, seed)).agg(F.avg("c").alias("rc"), F.avg("l").alias("rl"))
    return seen.join(by_chance, how="cross").select(F.try_divide(F.try_divide("c", "rc"), F.try_divide("l", "rl")).alias("small_world"))


def rich_club_ratio(net: Network, k: int | None = None, runs: int = 10, rounds: int = 20, seed: int = 1) -> DataFrame:
    """One row: `local.rich_club` and, as `ratio`, phi over its mean in networks with the same degrees; null where that is 0."""
    flat = Network(net.nodes, cut(net.simple().withColumn("weight", F.lit(1.0))), False)
    club = cut(local.rich_club(flat, k))
    rich = flat.around().groupBy("node").agg(F.count("*").alias("k")).join(F.broadcast(club.select("limit")), how="cross").filter("k > limit").select("node")
    inside = same_degrees(flat, runs, rounds, seed).join(rich.withColumnRenamed("node", "src"), "src", "left_semi").join(rich.withColumnRenamed("node", "dst"), "dst", "left_semi")
    mean = inside.agg((F.count("*") / runs).alias("mean"))  # the same nodes are rich in every run, so their pairs cancel
    return club.join(mean, how="cross").select(*club.columns, F.when(F.col("phi").isNotNull(), F.try_divide("m", "mean")).alias("ratio"))
