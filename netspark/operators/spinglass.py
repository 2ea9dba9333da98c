"""Spinglass: communities as the spins of a Potts model, cooled down slowly.

The energy of a pair in one community is its expected weight less its weight, so ties
hold together what is tied more than expected; with negative weights, what is tied
negatively more than expected is held apart. Nodes are dealt into colours such that no
two neighbours have the same; a colour's nodes draw new spins together (heat bath), which
changes none of each other's neighbours, and the spins' totals are those of before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut, discard
from .community import _named
from .structure import largest_component


def coloring(net: Network, seed: int = 1, most_rounds: int = 1000) -> DataFrame:
    """(node, color), from 0, neighbours never alike: a node takes the least color that its neighbours have not, once its draw is the highest of those around it without one."""
    around = cut(net.around())
    state = cut(net.nodes.select("node", F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node").alias("draw"), F.lit(None).cast("int").alias("color")))
    for _ in range(most_rounds):
        other = state.select(F.col("node").alias("other"), F.col("draw").alias("theirs"), F.col("color").alias("taken"))
        near = around.join(other, "other").groupBy("node").agg(F.max(F.when(F.col("taken").isNull(), F.col("theirs"))).alias("top"), F.collect_set("taken").alias("used"))
        free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"), 1)
        joined = state.join(near, "node", "left")
        on = F.col("color").isNull() & (F.col("top").isNull() | (F.col("draw") > F.col("top")))
        state = cut(joined.select("node", "draw", F.when(on, F.coalesce(free, F.lit(0))).otherwise(F.col("color")).alias("color")), state)
        if state.filter("color is null").isEmpty():
            discard(around)
            return state.select("node", "color")
    raise RuntimeError("colors did not settle")


def _sides(net: Network, weighted: bool, implementation: str) -> tuple[DataFrame, DataFrame]:
    """Ties (src, dst, plus, minus) and nodes (node, kp, km); weights over their mean size, so that temperatures mean the same for all."""
    w = F.col("weight") if weighted else F.lit(1.0)
    e = net.edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("w"))
    e = e.join(e.agg(F.avg(F.abs("w")).alias("mean")), how="cross").select("a", "b", (F.col("w") / F.col("mean")).alias("w"))
    minus = F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0) if implementation == "neg" else F.lit(0.0)
    plus = F.greatest("w", F.lit(0.0)) if implementation == "neg" else F.col("w")
    half = e.select("a", "b", plus.alias("plus"), minus.alias("minus"))
    ties = cut(half.union(half.select("b", "a", "plus", "minus")).toDF("src", "dst", "plus", "minus"))
    degree = ties.groupBy(F.col("src").alias("node")).agg(F.sum("plus").alias("kp"), F.sum("minus").alias("km"))
    return ties, cut(net.nodes.select("node").join(degree, "node", "left").fillna(0.0, ["kp", "km"]))


def energy(net: Network, membership: DataFrame, weighted: bool = True, update_rule: str = "config", gamma: float = 1.0, implementation: str = "orig", gamma_minus: float = 1.0) -> DataFrame:
    """One row: the energy of a membership (node, community), every pair of nodes once."""
    ties, nodes = _sides(net, weighted, implementation)
    own = nodes.join(membership.select("node", F.col("community").alias("s")), "node")
    a, b = (own.select(F.col("node").alias(e), F.col("s").alias(f"s_{e}")) for e in ("src", "dst"))
    inside = ties.join(a, "src").join(b, "dst").filter("s_src = s_dst").agg((F.coalesce(F.sum("plus"), F.lit(0.0)) / 2).alias("plus"), (F.coalesce(F.sum("minus"), F.lit(0.0)) / 2).alias("minus"))
    if update_rule == "config":
        groups = own.groupBy("s").agg((F.sum("kp") ** 2 - F.sum(F.col("kp") * F.col("kp"))).alias("p"), (F.sum("km") ** 2 - F.sum(F.col("km") * F.col("km"))).alias("m"))
        null = groups.agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
        all_ = nodes.agg(F.sum("kp").alias("tp"), F.sum("km").alias("tm"))
        expected = null.join(all_, how="cross").select((F.coalesce(F.try_divide("p", 2 * F.col("tp")), F.lit(0.0))).alias("ep"), F.coalesce(F.try_divide("m", 2 * F.col("tm")), F.lit(0.0)).alias("em"))
    else:
        pairs = own.groupBy("s").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n").alias("n"))
        all_ = nodes.agg(F.sum("kp").alias("tp"), F.sum("km").alias("tm"), F.count("*").alias("c"))
        rate = lambda t: F.col("n") * F.try_divide(F.col(t), F.col("c") * (F.col("c") - 1))
        expected = pairs.join(all_, how="cross").select(F.coalesce(rate("tp"), F.lit(0.0)).alias("ep"), F.coalesce(rate("tm"), F.lit(0.0)).alias("em"))
    return inside.join(expected, how="cross").select((-(F.col("plus") - gamma * F.col("ep")) + (F.col("minus") - gamma_minus * F.col("em"))).alias("energy"))


def spinglass(
    net: Network, weighted: bool = True, spins: int = 25, start_temp: float = 1.0, stop_temp: float = 0.01, cool_fact: float = 0.99, update_rule: str = "config",
    gamma: float = 1.0, implementation: str = "orig", gamma_minus: float = 1.0, seed: int = 1, most_rounds: int = 1000,
) -> DataFrame:
    """(node, community) of the largest component (other nodes are left out).

    Sweeps at temperatures from start_temp down to stop_temp, then at none until no node
    would change. update_rule: config (expected weights by degrees), random or simple
    (the same for all pairs); implementation: neg treats negative weights apart. Each
    sweep has a job a color; a larger cool_fact means more sweeps.
    """
    if update_rule not in ("config", "random", "simple") or implementation not in ("orig", "neg"):
        raise ValueError("an update rule is config, random or simple, an implementation orig or neg")
    whole = largest_component(net)
    ties, nodes = _sides(whole, weighted, implementation)
    colors = coloring(whole, seed)
    if update_rule != "config":
        nodes = nodes.withColumns({"kp": F.lit(1.0), "km": F.lit(1.0)})
    sums = ties.agg(F.sum("plus").alias("p"), F.sum("minus").alias("m")).first()
    n = nodes.count()
    rate = lambda t: 1.0 / t if t and update_rule == "config" else (t or 0.0) / max(1, n * (n - 1))
    over_p, over_m = gamma * rate(sums.p), gamma_minus * rate(sums.m)
    state = cut(nodes.join(colors, "node").withColumn("s", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(spins)).cast("int")))
    last = state.agg(F.max("color")).first()[0] or 0
    every = F.explode(F.sequence(F.lit(0), F.lit(spins - 1)))

    def offers(now: DataFrame, color: int | None) -> DataFrame:
        """(node, s, now, e): the energy of every spin for the nodes of a color (or for all)."""
        total = now.groupBy("s").agg(F.sum("kp").alias("tp"), F.sum("km").alias("tm"))
        turn = now if color is None else now.filter(F.col("color") == color)
        tied = ties.join(turn.select(F.col("node").alias("src")), "src").join(now.select(F.col("node").alias("dst"), "s"), "dst").groupBy(F.col("src").alias("node"), "s").agg(F.sum("plus").alias("p"), F.sum("minus").alias("m"))
        asked = turn.select("node", "kp", "km", F.col("s").alias("now"), every.alias("s"))
        own = lambda k: F.when(F.col("s") == F.col("now"), F.col(k)).otherwise(0.0)
        part = lambda got, k, t, over: F.coalesce(got, F.lit(0.0)) - over * F.col(k) * (F.coalesce(t, F.lit(0.0)) - own(k))
        e: Column = -part("p", "kp", "tp", over_p) + part("m", "km", "tm", over_m)
        return asked.join(tied, ["node", "s"], "left").join(total, "s", "left").select("node", "s", "now", e.alias("e"))

    sweep, heat = 0, start_temp
    while heat >= stop_temp:
        for color in range(last + 1):
            u = (F.shiftrightunsigned(F.xxhash64("node", "s", F.lit(seed), F.lit(sweep)), 12).cast("double") + 0.5) / float(1 << 52)
            drawn = offers(state, color).groupBy("node").agg(F.max_by("s", -F.col("e") / heat - F.ln(-F.ln(u))).alias("new"))
            state = cut(state.join(drawn, "node", "left").select("node", "kp", "km", "color", F.coalesce("new", "s").alias("s")), state)
        sweep, heat = sweep + 1, heat * cool_fact
    for i in range(most_rounds):
        best = offers(state, None).groupBy("node").agg(F.min_by("s", F.struct(F.round("e", 9), F.col("s") != F.col("now"), "s")).alias("new"))
        moved = cut(state.join(best, "node").withColumn("wants", F.col("new") != F.col("s")))
        if moved.filter("wants").isEmpty():
            return _named(state.select("node", F.col("s").alias("community")))
        parts = last + 2 + i // 12
        turn = F.pmod(F.xxhash64("node", F.lit(i // parts)), F.lit(parts)) == i % parts
        state = cut(moved.select("node", "kp", "km", "color", F.when(turn, F.col("new")).otherwise(F.col("s")).alias("s")), state)
    raise RuntimeError("spins did not settle")
