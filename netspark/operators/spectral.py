"""Measures that iterate a matrix: each step is a join with the arcs and a sum.

A few steps run as one job and end in a stored table; the loops go on until the
values settle, and raise if they do not within `most` steps.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..network import Network
from ..session import cut, discard

#: Steps between two stored tables, the largest change (relative to the largest value) that counts as settled, and the bound on steps.
EVERY, TOLERANCE, MOST = 4, 1e-8, 3000
#: Steps between two stored tables where a step reads its table once.
LONG = 8
#: Up to so many nodes linear systems are solved by elimination on the driver.
DIRECT = 100


def _start(net: Network, value: float = 1.0) -> DataFrame:
    return net.nodes.select("node", F.lit(value).alias("x"))


def _apply(x: DataFrame, arcs: DataFrame, weight: str = "weight") -> DataFrame:
    """(node, x, y): y_v = sum over arcs u -> v of x_u * weight, 0 without arcs."""
    own = x.select("node", "x", F.lit(None).cast("double").alias("y"))
    moved = arcs.join(x, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.lit(None).cast("double").alias("x"), (F.col("x") * F.col(weight)).alias("y"))
    return own.union(moved).groupBy("node").agg(F.max("x").alias("x"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).filter("x is not null")


def _weights(net: Network, weighted: bool) -> DataFrame:
    arcs = net.arcs().select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("weight"))
    if not net.directed:  # an undirected loop is walked both ways
        arcs = arcs.union(arcs.filter("src = dst"))
    return cut(arcs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def _even(arcs: DataFrame) -> DataFrame:
    """Weights over the largest sum at a node, so that steps neither grow nor vanish soon."""
    top = arcs.groupBy("src").agg(F.sum(F.abs("weight")).alias("s")).agg(F.max("s").alias("top"))
    return cut(arcs.join(top, how="cross").select("src", "dst", (F.col("weight") / F.col("top")).alias("weight")))


def linear(arcs: DataFrame, nodes: DataFrame, own: float = 0.0, constant: DataFrame | None = None, scale: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """The step x_v -> own * x_v + scale * (sum over arcs u -> v of x_u * weight) + constant_v.

    Every node has a cell to itself and the constant stands beside the cells, so a step
    reads x once: many steps make one plan, each a join and a sum.
    """
    cells = arcs.select("src", "dst", (scale * F.col("weight")).alias("weight")).union(nodes.select("node", F.col("node"), F.lit(float(own))))
    if constant is None:
        cells = cells.withColumn("more", F.lit(0.0))
    else:
        cells = cells.join(constant.select(F.col("node").alias("dst"), F.col("r").alias("more")), "dst").select("src", "dst", "weight", "more")
    cells = cut(cells)
    return lambda x: cells.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("x") * F.col("weight")) + F.max("more")).alias("x"))


def settled(x: DataFrame, step: Callable[[DataFrame], DataFrame], scaled: bool, every: int = EVERY, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """(node, x) when the steps change it no more; with `scaled` the largest is made 1 between the jobs."""
    x, old = cut(x), None
    for _ in range(0, most, every):
        y = x
        for _ in range(every):
            y = step(y)
        y = made = cut(y)
        if scaled:
            top = y.agg(F.max(F.abs("x")).alias("top"))
            y = y.join(top, how="cross").select("node", F.coalesce(F.try_divide("x", "top"), F.lit(0.0)).alias("x"))
        both = y.join(x.withColumnRenamed("x", "before"), "node").agg(F.max(F.abs(F.col("x") - F.col("before"))).alias("gap"), F.max(F.abs("x")).alias("top")).first()
        if old is not None:
            discard(old)
        x, old = y, made
        if both.gap is None or both.gap <= tolerance * max(both.top, 1e-300):
            return x
    raise RuntimeError(f"values still change after {most} steps")


def pagerank(net: Network, damping: float = 0.85, personalized: DataFrame | None = None, weighted: bool = True, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, pagerank), summing to 1; personalized: (node, weight). Rank without out-arcs is dealt out like jumps.

    Dealing it out only scales the solution, so the steps are z = r + damping P'z
    with the jumps r, and the sum is made 1 at the end.
    """
    arcs = _weights(net, weighted)
    share = cut(arcs.join(arcs.groupBy("src").agg(F.sum("weight").alias("s")), "src").select("src", "dst", (F.col("weight") / F.col("s")).alias("weight")))
    jump = net.nodes.select("node", F.lit(1.0).alias("r")) if personalized is None else net.nodes.select("node").join(personalized, "node", "left").select("node", F.coalesce("weight", F.lit(0.0)).alias("r"))
    total = jump.agg(F.sum("r").alias("s"))
    jump = cut(jump.join(total, how="cross").select("node", (F.col("r") / F.col("s")).alias("r")))
    z = settled(jump.withColumnRenamed("r", "x"), linear(share, net.nodes, 0.0, jump, damping), False, LONG, tolerance)
    total = z.agg(F.sum("x").alias("s"))
    return z.join(total, how="cross").select("node", (F.col("x") / F.col("s")).alias("pagerank"))


def _scaled(x: DataFrame, column: str, out: str) -> DataFrame:
    top = x.agg(F.max(F.abs(column)).alias("top"))
    return x.join(top, how="cross").select("node", F.coalesce(F.try_divide(column, "top"), F.lit(0.0)).alias(out))


def eigenvector(net: Network, weighted: bool = True) -> DataFrame:
    """(node, eigenvector): dominant eigenvector by in-links, largest 1; A + I keeps bipartite networks from swinging."""
    arcs = _even(_weights(net, weighted))
    return settled(_start(net), linear(arcs, net.nodes, 1.0), True, LONG).withColumnRenamed("x", "eigenvector")


def hits(net: Network, weighted: bool = True) -> DataFrame:
    """(node, hub, authority), each with largest 1."""
    arcs = _even(_weights(net, weighted))
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    there, here = linear(arcs, net.nodes), linear(back, net.nodes)
    hub = settled(_start(net), lambda x: here(there(x)), True, every=LONG // 2)
    authority = _scaled(_apply(hub, arcs), "y", "authority")
    return hub.withColumnRenamed("x", "hub").join(authority, "node")


def hits_value(net: Network, weighted: bool = True) -> DataFrame:
    """One row (value): the largest eigenvalue of A A', to which both scores of `hits` belong."""
    arcs = _weights(net, weighted)
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    hub = hits(net, weighted).select("node", F.col("hub").alias("x"))
    there = _apply(hub, arcs).select("node", F.col("y").alias("x"))
    return _apply(there, back).agg(F.coalesce(F.max("y"), F.lit(0.0)).alias("value"))


def _solved(net: Network, arcs: DataFrame, scale: float, right: DataFrame, tolerance: float = 1e-10, most: int = 2000) -> DataFrame:
    """(node, x) with x_v - scale * (sum over arcs u -> v of x_u * weight) = right_v; right: (node, x).

    Conjugate gradients on the normal equations, so any regular system is solved, the
    scale being beyond the spectral radius or not. A step is one job: the matrix, its
    transpose and two sums. Raises if the system has no solution.
    """
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def times(df: DataFrame, column: str, over: DataFrame) -> DataFrame:
        """df with `mx`: the matrix (over arcs), or its transpose (over back), times a column."""
        moved = over.join(df.select(F.col("node").alias("src"), F.col(column).alias("v")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("v") * F.col("weight")).alias("y"))
        return df.join(moved, "node", "left").withColumn("mx", F.col(column) - scale * F.coalesce("y", F.lit(0.0))).drop("y")

    def with_sum(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(df.agg(F.sum(F.col(column) * F.col(column)).alias(name)), how="cross")

    start = right.select("node", F.lit(0.0).alias("x"), F.col("x").alias("r"))
    state = cut(with_sum(times(start, "r", back).withColumn("z", F.col("mx")).select("node", "x", "r", "z", F.col("z").alias("p")), "z", "zz"))
    size = state.agg(F.max(F.abs("r"))).first()[0] or 0.0
    for _ in range(most):
        rest = state.agg(F.max(F.abs("r")).alias("r"), F.max("zz").alias("zz")).first()
        if not rest.r or rest.r <= tolerance * size:
            return state.select("node", "x")
        if not rest.zz or rest.zz <= 1e-30 * size * size:
            break
        walked = with_sum(times(state, "p", arcs), "mx", "ww")
        a = F.col("zz") / F.col("ww")
        moved = walked.select("node", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("mx")).alias("r"), "p", "zz")
        turned = with_sum(times(moved, "r", back).withColumn("z", F.col("mx")).drop("mx"), "z", "new")
        state = cut(turned.select("node", "x", "r", "z", (F.col("z") + F.col("new") / F.col("zz") * F.col("p")).alias("p"), F.col("new").alias("zz")), state)
    raise RuntimeError("the system has no solution, or is too near to one without")


def _plain(table: list[list[float]]) -> list[float]:
    """The last column after Gauss and Jordan without a search for pivots, as their SQL does it, to the last bit; empty where a pivot vanishes."""
    for k in range(len(table)):
        pivot = table[k]
        if pivot[k] == 0:
            return []
        table = [[x / pivot[k] for x in row] if i == k else [x - row[k] / pivot[k] * y for x, y in zip(row, pivot)] for i, row in enumerate(table)]
    return [row[-1] for row in table]


def _exact(table: list[list[float]]) -> list[Fraction]:
    """The solution without any rounding, by elimination in whole numbers (Bareiss); empty if there is none or more than one."""
    rows, last = [], 1
    for row in table:
        parts = [Fraction(x) for x in row]
        unit = max(x.denominator for x in parts)  # powers of two
        rows.append([x.numerator * (unit // x.denominator) for x in parts])
    for k in range(len(rows)):
        at = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if at is None:
            return []
        rows[k], rows[at] = rows[at], rows[k]
        top = rows[k]
        for i in range(k + 1, len(rows)):
            own = rows[i]
            rows[i] = [0] * (k + 1) + [(top[k] * own[j] - own[k] * top[j]) // last for j in range(k + 1, len(own))]
        last = top[k]
    found: list[int] = []  # the unknowns times the determinant, whole too
    for k in reversed(range(len(rows))):
        row = rows[k]
        found.insert(0, (last * row[-1] - sum(x * y for x, y in zip(row[k + 1 : -1], found))) // row[k])
    return [Fraction(x, last) for x in found]


def _eliminated(nodes: DataFrame, arcs: DataFrame, scale: float, right: DataFrame) -> DataFrame:
    """The solution of `_solved` for at most DIRECT nodes, whose table the driver reads; rows in the order of names.

    Plain elimination where it gives each value to nine digits, or to the rounding of the
    largest; else, as where it divides by a difference of nearly equal numbers, the exact
    solution. Raises if there is none or more than one, also where the last digit of the
    scale decides it.
    """
    names = [r.node for r in nodes.select("node").orderBy("node").collect()]
    cells = {(r.dst, r.src): r.weight for r in arcs.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("weight")).collect()}
    given = {r.node: float(r.x) for r in right.collect()}

    def table(scale: float) -> list[list[float]]:
        return [[float(v == u) - scale * (cells.get((v, u)) or 0.0) for u in names] + [given[v]] for v in names]

    exact = _exact(table(scale))
    size = max(map(abs, exact), default=0)
    if size > 1e12 * max(map(abs, given.values()), default=0.0):
        near = _exact(table(math.nextafter(scale, math.inf)))
        exact = exact if near and max(abs(x - y) for x, y in zip(exact, near)) < size / 10 else []
    if names and not exact:
        raise RuntimeError("the system has no solution, or more than one")
    plain = _plain(table(scale))
    x = [float(x) for x in exact]
    if plain and all(math.isclose(p, y, rel_tol=1e-9, abs_tol=len(names) * sys.float_info.epsilon * float(size)) for p, y in zip(plain, x)):
        x = plain
    return nodes.sparkSession.createDataFrame(list(zip(names, x)), StructType([nodes.schema["node"], StructField("x", DoubleType())]))


def _solution(net: Network, arcs: DataFrame, scale: float, right: DataFrame) -> DataFrame:
    """By elimination up to DIRECT nodes, else by gradients; right: (node, x)."""
    few = net.nodes.limit(DIRECT + 1).count() <= DIRECT
    return _eliminated(net.nodes, arcs, scale, right) if few else _solved(net, arcs, scale, right)


def alpha_centrality(net: Network, alpha: float = 1.0, exogenous: float = 1.0, weighted: bool = False) -> DataFrame:
    """(node, alpha): x = alpha A'x + e, for any alpha that is not one over an eigenvalue."""
    return _solution(net, _weights(net, weighted), alpha, _start(net, exogenous)).withColumnRenamed("x", "alpha")


def power_centrality(net: Network, exponent: float = 1.0, weighted: bool = False) -> DataFrame:
    """(node, power): Bonacich power (I - exponent A) c = A 1, scaled so that squares sum to n.

    One over an eigenvalue is no exponent: elimination raises there, gradients give the shortest solution if there are any.
    """
    arcs = cut(_weights(net, weighted).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ones = _apply(_start(net), arcs).select("node", F.col("y").alias("x"))
    x = cut(_solution(net, arcs, exponent, ones))
    norm = x.agg(F.sqrt(F.try_divide(F.count("*"), F.sum(F.col("x") * F.col("x")))).alias("f"))
    return x.join(norm, how="cross").select("node", (F.col("x") * F.coalesce("f", F.lit(0.0))).alias("power"))


def subgraph_centrality(net: Network, tolerance: float = 1e-12, most: int = 500) -> DataFrame:
    """Closed walks at each node, those of length k weighed by 1 / k!: the diagonal of exp(A), loops left out.

    The state is a row for each pair of nodes on a walk; terms are added until all
    walks of a length together weigh less than `tolerance` of what is there.
    """
    arcs = cut(Network(net.nodes, net.edges.filter("src <> dst"), net.directed).arcs().select("src", "dst").distinct())
    walks = net.nodes.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("c"))
    total, sum_, last = net.nodes.select("node", F.lit(1.0).alias("c")), 1.0, None
    for k in range(1, most):
        walks = cut(walks.join(arcs, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg((F.sum("c") / k).alias("c")))
        total = total.union(walks.filter("source = node").select("node", "c"))
        row = walks.agg(F.max("c").alias("m")).first().m or 0.0
        sum_ += row
        if row <= tolerance * sum_ and last is not None and row <= last:
            break
        last = row
    else:
        raise RuntimeError("walks still matter")
    return total.groupBy("node").agg(F.sum("c").alias("subgraph"))
