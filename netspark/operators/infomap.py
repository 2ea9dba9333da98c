"""Infomap: the partition under which a random walk takes fewest bits to tell (the map equation).

A walk follows the edges by weight and jumps with probability `jump` (from a node without
out-edges always), by `v_weights` or evenly. All trials are one disjoint union: each has
its own turns, and each job moves nodes of all of them. Nodes go to the neighbouring
module that shortens the code most; then the modules become nodes, until none moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut, discard
from .community import _named
from .spectral import pagerank


def plogp(x: Column) -> Column:
    return F.when(x > 1e-300, x * F.log2(x)).otherwise(0.0)


def flow(net: Network, weighted: bool = True, jump: float = 0.15, v_weights: DataFrame | None = None, recorded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, p, j, t) and links (src, dst, f) of a walk, per step.

    p: how often a node is visited, j: how often the walk jumps from it, t: how likely a
    jump ends there, f: how often a link between two nodes is taken. Jumps that are not
    recorded tell where the walk is, but count neither as visits nor as exits.
    """
    rank = pagerank(net, 1 - jump, v_weights, weighted, tolerance=1e-10).withColumnRenamed("pagerank", "p")
    arcs = net.arcs().select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = arcs.groupBy("src").agg(F.sum("w").alias("s"))
    to = net.nodes.select("node", F.lit(1.0).alias("t")) if v_weights is None else net.nodes.select("node").join(v_weights.select("node", F.col("weight").alias("t")), "node", "left").fillna(0.0, ["t"])
    to = to.join(to.agg(F.sum("t").alias("all")), how="cross").select("node", (F.col("t") / F.col("all")).alias("t"))
    nodes = cut(rank.join(to, "node").join(out.withColumnRenamed("src", "node"), "node", "left"))
    links = arcs.join(out, "src").join(nodes.select(F.col("node").alias("src"), "p"), "src").select("src", "dst", (F.col("p") * F.col("w") / F.col("s")).alias("f"))
    if recorded:
        jumps = F.when(F.col("s").isNull(), F.col("p")).otherwise(jump * F.col("p"))
        return cut(nodes.select("node", "p", jumps.alias("j"), "t")), cut(links.select("src", "dst", ((1 - jump) * F.col("f")).alias("f")))
    links = cut(links.join(links.agg(F.sum("f").alias("all")), how="cross").select("src", "dst", (F.col("f") / F.col("all")).alias("f")))
    into = links.groupBy(F.col("dst").alias("node")).agg(F.sum("f").alias("p"))
    return cut(nodes.select("node", "t").join(into, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"), F.lit(0.0).alias("j"), "t")), links


def _modules(own: DataFrame, links: DataFrame) -> DataFrame:
    """(trial, c, p, j, t, out, q): the modules of own (trial, node, c, p, j, t); q is how often the walk leaves one."""
    a, b = (own.select("trial", F.col("node").alias(e), F.col("c").alias(f"c_{e}")) for e in ("src", "dst"))
    leaves = links.join(a, ["trial", "src"]).join(b, ["trial", "dst"]).filter("c_src <> c_dst").groupBy("trial", F.col("c_src").alias("c")).agg(F.sum("f").alias("out"))
    sums = own.groupBy("trial", "c").agg(F.sum("p").alias("p"), F.sum("j").alias("j"), F.sum("t").alias("t"))
    return sums.join(leaves, ["trial", "c"], "left").fillna(0.0, ["out"]).withColumn("q", F.col("j") * (1 - F.col("t")) + F.col("out"))


def _length(modules: DataFrame, entropy: DataFrame) -> DataFrame:
    """(trial, bits) of the two-level code; entropy: one row, the sum of plogp over the nodes."""
    sums = modules.groupBy("trial").agg(F.sum("q").alias("all"), F.sum(plogp(F.col("q"))).alias("exits"), F.sum(plogp(F.col("q") + F.col("p"))).alias("stays"))
    return sums.join(entropy, how="cross").select("trial", (plogp(F.col("all")) - 2 * F.col("exits") - F.col("entropy") + F.col("stays")).alias("bits"))


def code_length(net: Network, membership: DataFrame, **walk) -> DataFrame:
    """One row: bits a step that the two-level code of a membership (node, community) takes."""
    nodes, links = flow(net, **walk)
    own = nodes.join(membership.select("node", F.col("community").alias("c")), "node").withColumn("trial", F.lit(0))
    return _length(_modules(own, links.withColumn("trial", F.lit(0))), nodes.agg(F.sum(plogp(F.col("p"))).alias("entropy"))).select("bits")


def _moves(nodes: DataFrame, links: DataFrame, most_rounds: int) -> DataFrame:
    """(trial, node, c) after moves, from every node alone; nodes (trial, node, p, j, t), links (trial, src, dst, f)."""
    apart = links.filter("src <> dst")
    near = apart.select("trial", F.col("src").alias("node"), F.col("dst").alias("other"), F.col("f").alias("o"), F.lit(0.0).alias("n")).union(apart.select("trial", "dst", "src", F.lit(0.0), "f"))
    near = cut(near.groupBy("trial", "node", "other").agg(F.sum("o").alias("o"), F.sum("n").alias("n")))
    total = near.groupBy("trial", "node").agg(F.sum("o").alias("leaves"))
    own = cut(nodes.join(total, ["trial", "node"], "left").fillna(0.0, ["leaves"]).withColumn("c", F.col("node")))
    for i in range(most_rounds):
        modules = cut(_modules(own, apart))
        every = modules.groupBy("trial").agg(F.sum("q").alias("all"))
        met = near.join(own.select("trial", F.col("node").alias("other"), F.col("c").alias("to")), ["trial", "other"]).groupBy("trial", "node", "to").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
        met = met.join(own, ["trial", "node"])
        here = met.filter("to = c").select("trial", "node", F.col("o").alias("o_c"), F.col("n").alias("n_c"))
        old, new = (modules.select("trial", F.col("c").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("p", "j", "t", "out", "q")]) for k in ("c", "to"))
        offers = met.filter("to <> c").join(here, ["trial", "node"], "left").fillna(0.0, ["o_c", "n_c"]).join(old, ["trial", "c"]).join(new, ["trial", "to"]).join(every, "trial")
        left_q = (F.col("j_c") - F.col("j")) * (1 - F.col("t_c") + F.col("t")) + F.col("out_c") - (F.col("leaves") - F.col("o_c")) + F.col("n_c")
        then_q = (F.col("j_to") + F.col("j")) * (1 - F.col("t_to") - F.col("t")) + F.col("out_to") - F.col("n") + F.col("leaves") - F.col("o")
        offers = offers.withColumn("left_q", F.greatest(left_q, F.lit(0.0))).withColumn("then_q", F.greatest(then_q, F.lit(0.0)))
        q, p = F.col, F.col
        delta = (
            plogp(q("all") - q("q_c") - q("q_to") + q("left_q") + q("then_q")) - plogp(q("all"))
            - 2 * (plogp(q("left_q")) + plogp(q("then_q")) - plogp(q("q_c")) - plogp(q("q_to")))
            + plogp(q("left_q") + p("p_c") - p("p")) + plogp(q("then_q") + p("p_to") + p("p")) - plogp(q("q_c") + p("p_c")) - plogp(q("q_to") + p("p_to"))
        )
        best = offers.withColumn("d", F.round(delta, 10)).filter("d < 0").groupBy("trial", "node").agg(F.min(F.struct("d", "to")).alias("best"))
        parts = 2 + i // 6
        turn = F.pmod(F.xxhash64("node", "trial", F.lit(i // parts)), F.lit(parts)) == i % parts
        moved = own.join(best, ["trial", "node"], "left").select("trial", "node", "p", "j", "t", "leaves", F.when(turn & F.col("best").isNotNull(), F.col("best.to")).otherwise(F.col("c")).alias("c"), F.col("best").isNotNull().alias("wants"))
        own = cut(moved, own)
        discard(modules)
        if own.filter("wants").isEmpty():
            return own.select("trial", "node", "c")
        own = own.drop("wants")
    raise RuntimeError("moves did not settle")


def trials(net: Network, nb_trials: int = 10, weighted: bool = True, jump: float = 0.15, v_weights: DataFrame | None = None, recorded: bool = True, most_levels: int = 100, most_rounds: int = 400, walk: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(trial, node, community) and (trial, bits) of every trial; walk: what `flow` gives, where it is known."""
    nodes, links = walk or flow(net, weighted, jump, v_weights, recorded)
    entropy = nodes.agg(F.sum(plogp(F.col("p"))).alias("entropy"))
    numbers = F.broadcast(net.nodes.sparkSession.range(nb_trials).select(F.col("id").cast("int").alias("trial")))
    base, arcs = cut(nodes.join(numbers, how="cross")), cut(links.join(numbers, how="cross"))
    level, flows, member = base, arcs, cut(base.select("trial", "node", F.col("node").alias("community")))
    for _ in range(most_levels):
        moved = cut(_moves(level, flows, most_rounds))
        if moved.filter("node <> c").isEmpty():
            break
        member = cut(member.join(moved.withColumnRenamed("node", "community"), ["trial", "community"]).select("trial", "node", F.col("c").alias("community")), member)
        a, b = (moved.select("trial", F.col("node").alias(e), F.col("c").alias(f"c_{e}")) for e in ("src", "dst"))
        level = cut(level.join(moved, ["trial", "node"]).groupBy("trial", F.col("c").alias("node")).agg(F.sum("p").alias("p"), F.sum("j").alias("j"), F.sum("t").alias("t")))
        flows = cut(flows.join(a, ["trial", "src"]).join(b, ["trial", "dst"]).groupBy("trial", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("f").alias("f")))
    else:
        raise RuntimeError("levels did not end")
    own = base.join(member.withColumnRenamed("community", "c"), ["trial", "node"])
    return member, cut(_length(_modules(own, arcs), entropy))


def infomap(net: Network, weighted: bool = True, nb_trials: int = 10, v_weights: DataFrame | None = None, jump: float = 0.15, recorded: bool = True) -> DataFrame:
    """(node, community) of the trial with the shortest code; one module of all nodes if no code is shorter than its."""
    walk = flow(net, weighted, jump, v_weights, recorded)
    member, bits = trials(net, nb_trials, weighted, jump, v_weights, recorded, walk=walk)
    best = bits.orderBy(F.round("bits", 9), "trial").first()
    if best is None:
        return net.nodes.select("node", F.col("node").alias("community"))
    whole = -(walk[0].agg(F.sum(plogp(F.col("p")))).first()[0] or 0.0)
    found = member.filter(F.col("trial") == best.trial).select("node", "community")
    return _named(found if best.bits < whole - 1e-9 else found.join(found.agg(F.min("node").alias("one")), how="cross").select("node", F.col("one").alias("community")))
