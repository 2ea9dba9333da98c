"""What is left of the largest component while nodes or edges go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from . import paths
from .components import connected_components


def _merges(edges: DataFrame, last: int) -> DataFrame:
    """(run, step, size): components that arise when edges (run, src, dst, at) come back in the order of falling `at`, each with the size it has when all of its step are back.

    An edge is there as long as fewer than `at` steps are done. Steps are halved again and
    again: the later half of a range is a problem of its own; what it joins stands as one
    node, with its size, in the earlier half. So every edge is in one range at a time, and
    all runs and ranges are searched together as one disjoint union.
    """
    open_ = cut(edges.select("run", F.lit(0).alias("low"), F.lit(last).alias("high"), "src", "dst", "at", F.lit(1).cast("long").alias("src_n"), F.lit(1).cast("long").alias("dst_n")))
    found = []
    while not open_.isEmpty():
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        now = open_.withColumn("mid", mid)
        late = now.filter("at > mid")
        key = lambda c: F.struct("run", "low", "high", F.col(c).alias("node")).alias(c)
        of = connected_components(late.select(key("src"), key("dst")))
        of = cut(of.select("node.run", "node.low", "node.high", "node.node", F.col("component.node").alias("to")))
        held = late.select("run", "low", "high", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_n").alias("n")), F.struct(F.col("dst").alias("node"), F.col("dst_n").alias("n")))).alias("x")).select("run", "low", "high", "x.node", "x.n").distinct()
        sizes = cut(held.join(of, ["run", "low", "high", "node"]).groupBy("run", "low", "high", "to").agg(F.sum("n").alias("n")))
        found.append(sizes.filter("high - low = 1").select("run", F.col("high").alias("step"), F.col("n").alias("size")))
        early = now.filter("at <= mid")
        for end in ("src", "dst"):
            to = of.join(sizes, ["run", "low", "high", "to"]).select("run", "low", "high", F.col("node").alias(end), "to", "n")
            early = early.join(to, ["run", "low", "high", end], "left").select("run", "low", "high", "mid", *[F.coalesce("to", c).alias(c) if c == end else F.col(c) for c in ("src", "dst")], "at", *[F.coalesce("n", c).alias(c) if c == f"{end}_n" else F.col(c) for c in ("src_n", "dst_n")])
        a, b = F.least("src", "dst"), F.greatest("src", "dst")
        turned = F.col("src") > F.col("dst")
        early = early.filter("src <> dst").groupBy("run", "low", F.col("mid").alias("high"), a.alias("a"), b.alias("b")).agg(F.max("at").alias("at"), F.first(F.when(turned, F.col("dst_n")).otherwise(F.col("src_n"))).alias("a_n"), F.first(F.when(turned, F.col("src_n")).otherwise(F.col("dst_n"))).alias("b_n"))
        early = early.select("run", "low", "high", F.col("a").alias("src"), F.col("b").alias("dst"), "at", F.col("a_n").alias("src_n"), F.col("b_n").alias("dst_n"))
        late = late.filter("high - low > 1").select("run", F.col("mid").alias("low"), "high", "src", "dst", "at", "src_n", "dst_n")
        open_ = cut(early.union(late), open_)
    return reduce(DataFrame.union, found) if found else edges.select("run", F.col("at").alias("step"), F.lit(0).cast("long").alias("size")).limit(0)


def attack_curve(net: Network, ranks: DataFrame, by: str = "vertex") -> DataFrame:
    """(step, removed_pct, comp_size, comp_pct), means over runs; ranks: (run, node, rank) or (run, src, dst, rank), ranks from 1 in the order of removal.

    The largest component after k removals is the largest that arises while what is
    removed later comes back, so one pass over the merges answers all steps.
    """
    spark, s = net.nodes.sparkSession, net.simple()
    ranks = cut(ranks)
    n = net.nodes.count()
    last, runs = (r or 0 for r in ranks.agg(F.max("rank"), F.countDistinct("run")).first())
    if by == "vertex":
        a, b = (ranks.select("run", F.col("node").alias(x), F.col("rank").alias(f"r_{x}")) for x in ("src", "dst"))
        edges = s.join(a, "src").join(b, ["run", "dst"]).select("run", "src", "dst", F.least("r_src", "r_dst").alias("at"))
    else:
        edges = ranks.select("run", "src", "dst", F.col("rank").alias("at"))
    # A component of `at` 1 more than k is there after k removals; alone, a node is a component of its own.
    most = _merges(edges, last).groupBy("run", "step").agg(F.max("size").alias("size"))
    steps = spark.range(last + 1).select(F.col("id").cast("int").alias("step"))
    grid = ranks.select("run").distinct().join(steps, how="cross")  # a row a run and step, as many as ranks
    since = Window.partitionBy("run").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    alone = F.when(F.col("step") == last, 0).otherwise(1) if by == "vertex" else F.lit(1 if n else 0)
    sized = grid.join(most, ["run", "step"], "left").withColumn("m", F.greatest(F.max("size").over(since), alone))
    if by == "edge":
        sized = sized.withColumn("m", F.when(F.col("step") == last, 0).otherwise(F.col("m")))
    mean = cut(sized.groupBy("step").agg(F.avg("m").alias("comp_size")))
    top = mean.filter("step = 0").select(F.col("comp_size").alias("top"))
    return mean.join(top, how="cross").select("step", (F.col("step") / (last or 1)).alias("removed_pct"), "comp_size", F.coalesce(F.try_divide("comp_size", "top"), F.lit(0.0)).alias("comp_pct"))


def random_ranks(things: DataFrame, runs: int, seed: int) -> DataFrame:
    """things with (run, rank): an order of its own for each run, by hash.

    Ranks are counted in parts of the hash, so no task sorts a whole run.
    """
    runs_ = things.sparkSession.range(runs).withColumnRenamed("id", "run")
    drawn = things.join(F.broadcast(runs_), how="cross").withColumn("h", F.xxhash64("run", F.lit(seed), *things.columns))
    drawn = drawn.withColumn("part", F.shiftright("h", 58))
    before = drawn.groupBy("run", "part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("run", "part").orderBy("h", *things.columns))
    return drawn.withColumn("within", within).join(before, ["run", "part"]).select("run", *things.columns, (F.col("before") + F.col("within")).cast("int").alias("rank"))


def random_attack(net: Network, runs: int = 100, seed: int = 1, by: str = "vertex") -> DataFrame:
    """(step, removed_pct, comp_size, comp_pct), means over runs of removals in random order."""
    things = net.nodes.select("node") if by == "vertex" else net.simple()
    return attack_curve(net, random_ranks(things, runs, seed), by)


def degree_order(net: Network) -> list:
    """Nodes in the order in which the one of the highest degree (then the least name) goes, degrees being counted anew each time.

    A removal is a job over the edges left, and the order depends on every step before:
    for networks of hundreds of nodes.
    """
    around, order = cut(net.around()), []
    names = [r.node for r in net.nodes.select("node").orderBy("node").collect()]
    while True:
        top = around.groupBy("node").count().orderBy(F.desc("count"), "node").first()
        if top is None:
            rest = [n for n in names if n not in set(order)]
            return order + rest
        order.append(top.node)
        around = cut(around.filter((F.col("node") != top.node) & (F.col("other") != top.node)), around)


def _betweenness_order(net: Network, by: str) -> list:
    """Nodes or edges in the order of highest betweenness, computed anew after each removal."""
    nodes, edges, order = cut(net.nodes.select("node")), cut(net.simple().withColumn("weight", F.lit(1.0))), []
    while not edges.isEmpty():
        now = Network(nodes, edges, False)
        if by == "vertex":
            top = paths.betweenness(now).orderBy(F.desc(F.round("betweenness", 9)), "node").first().node
            order.append(top)
            nodes, edges = cut(nodes.filter(F.col("node") != top), nodes), cut(edges.filter((F.col("src") != top) & (F.col("dst") != top)), edges)
        else:
            top = paths.edge_betweenness(now).orderBy(F.desc(F.round("betweenness", 9)), "src", "dst").first()
            order.append((top.src, top.dst))
            edges = cut(edges.filter(~((F.col("src") == top.src) & (F.col("dst") == top.dst))), edges)
    if by == "vertex":  # without edges all are alike
        order += [r.node for r in nodes.select("node").orderBy("node").collect()]
    return order


def targeted_attack(net: Network, measure: str = "degree", by: str = "vertex") -> DataFrame:
    """(step, removed_pct, comp_size, comp_pct): what is highest by the measure goes, each time anew."""
    order = degree_order(net) if by == "vertex" and measure == "degree" else _betweenness_order(net, by)
    spark, kind = net.nodes.sparkSession, net.nodes.schema["node"].dataType.simpleString()
    if by == "vertex":
        ranks = spark.createDataFrame([(0, node, i) for i, node in enumerate(order, 1)], f"run long, node {kind}, rank int")
    else:
        ranks = spark.createDataFrame([(0, a, b, i) for i, (a, b) in enumerate(order, 1)], f"run long, src {kind}, dst {kind}, rank int")
    return attack_curve(net, ranks, by)


def vertex_attack(net: Network, measure: str = "degree") -> DataFrame:
    return targeted_attack(net, measure)


def robustness(net: Network, measure: str = "degree", type: str = "vertex", runs: int = 100, seed: int = 1) -> DataFrame:
    """The curve of an attack; measure degree, betweenness or random, type vertex or edge."""
    if measure not in ("degree", "betweenness", "random") or type not in ("vertex", "edge"):
        raise ValueError("a measure is degree, betweenness or random, a type vertex or edge")
    if measure == "random":
        return random_attack(net, runs, seed, type)
    if type == "edge" and measure == "degree":
        raise ValueError("edges have no degree")
    return targeted_attack(net, measure, type)


def auc(curve: DataFrame, *keys: str) -> DataFrame:
    """Area under comp_pct by removed_pct, by trapezoids."""
    order = Window.partitionBy(*keys).orderBy("removed_pct")
    part = (F.col("removed_pct") - F.lag("removed_pct").over(order)) * (F.col("comp_pct") + F.lag("comp_pct").over(order)) / 2
    return curve.select(*keys, part.alias("part")).groupBy(*keys).agg(F.sum("part").alias("auc"))


def summary(curve: DataFrame, *keys: str) -> DataFrame:
    """auc and the first removed_pct with comp_pct below 0.5 and 0.1 (1 if never), to four digits."""
    first = lambda x: F.round(F.coalesce(F.min(F.when(F.col("comp_pct") < x, F.col("removed_pct"))), F.lit(1.0)), 4)
    points = curve.groupBy(*keys).agg(first(0.5).alias("half"), first(0.1).alias("tenth"))
    area = auc(curve, *keys).withColumn("auc", F.round("auc", 4))
    return points.join(area, list(keys)) if keys else points.join(area, how="cross")
