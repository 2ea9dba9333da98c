"""Resampling over cases: what a replicate draws is split down a tree of blocks of cases (`draws`), so a replicate is a grouped sum of the blocks' sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut
from . import paths
from .degree import pearson
from .draws import drawn_counts, numbered
from .ordered import running


def _replicates(df: DataFrame, iterations: int) -> DataFrame:
    return df.join(df.sparkSession.range(1, iterations + 1).withColumnRenamed("id", "iter"), how="cross")


def weigh(counts: DataFrame, *keys: str, kind: str = "relative") -> DataFrame:
    """Counts with a weight: relative, the share of what leaves src (within the keys), or frequency, the count itself."""
    if kind not in ("relative", "frequency"):
        raise ValueError("weights are relative or frequency")
    own = F.col("count").cast("double")
    return counts.withColumn("weight", own if kind == "frequency" else own / F.sum("count").over(Window.partitionBy(*keys, "src")))


def bootstrap_edges(
    cases: DataFrame, iterations: int = 1000, level: float = 0.05, consistency: tuple[float, float] = (0.75, 1.25), seed: int = 1,
    method: str = "stability", threshold: float | None = None, kind: str = "relative",
) -> DataFrame:
    """Stability of transition weights (of a kind of `weigh`); cases (case, src, dst, count).

    A replicate draws as many cases as there are, each with equal chance and put
    back. Columns: src, dst, weight, mean, sd, ci_lower, ci_upper, p_value. With
    method "threshold" p_value is the share of replicates below the threshold (else the
    first decile of all cells of the matrix) in place of those outside the consistent range.
    """
    if method not in ("stability", "threshold"):
        raise ValueError("a method is stability or threshold")
    placed = cut(numbered(cases))
    n = placed.count()
    counts = drawn_counts(cases, [n], n, placed, iterations, True, seed).drop("draw")
    reps = weigh(counts, "iter", kind=kind).select("iter", "src", "dst", F.col("weight").alias("w"))
    seen = weigh(cases.groupBy("src", "dst").agg(F.sum("count").alias("count")), kind=kind).select("src", "dst", "weight")
    full = _replicates(seen, iterations).join(reps, ["iter", "src", "dst"], "left").fillna(0.0, ["w"])
    if method == "stability":
        failed = (F.col("w") <= consistency[0] * F.col("weight")) | (F.col("w") >= consistency[1] * F.col("weight"))
    elif threshold is not None:
        failed = F.col("w") < threshold
    else:
        # The cells of edges that no case has are zeros.
        states = seen.select("src").union(seen.select("dst")).distinct().count()
        cells = seen.select("weight", F.lit(1).cast("long").alias("n")).union(seen.agg(F.lit(0.0), F.lit(states * states) - F.count("*")))
        least = F.broadcast(cells.agg(F.percentile("weight", F.lit(0.1), F.col("n")).alias("least")))  # one row
        full, failed = full.join(least, how="cross"), F.col("w") < F.col("least")
    return full.groupBy("src", "dst", "weight").agg(
        F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"), F.percentile("w", F.lit(level / 2)).alias("ci_lower"), F.percentile("w", F.lit(1 - level / 2)).alias("ci_upper"),
        ((F.sum(failed.cast("int")) + 1) / (iterations + 1)).alias("p_value"),
    )


def permutation_edges(cases: DataFrame, groups: DataFrame, iterations: int = 1000, seed: int = 1, pairs: DataFrame | None = None, correction: str = "none", kind: str = "relative") -> DataFrame:
    """Difference of two groups' transition weights against shuffled groups; groups (case, grp) with two values of grp.

    Columns: src, dst, diff, effect, p_value. Group sizes stay as they are. With
    pairs (case, pair) the two cases of a pair change sides together; cases
    without a pair are left out. correction as in `adjust`.
    """
    sides = groups.select("grp").distinct().orderBy("grp").limit(2).withColumn("side", F.row_number().over(Window.orderBy("grp")))
    placed = groups.join(sides, "grp").select("case", "side")
    if pairs is not None:
        placed = placed.join(pairs.select("case", "pair"), "case")
    placed = cut(placed)
    seen = cases.join(placed, "case").groupBy("side", "src", "dst").agg(F.sum("count").alias("count"))
    if pairs is not None:
        swap = F.pmod(F.xxhash64("iter", "pair", F.lit(seed)), F.lit(2)) == 0
        shuffled = _replicates(placed, iterations).select("iter", "case", F.when(swap, 3 - F.col("side")).otherwise(F.col("side")).cast("int").alias("side"))
        counts = cases.join(shuffled, "case").groupBy("iter", "side", "src", "dst").agg(F.sum("count").alias("count"))
    else:
        # One side is drawn; what it leaves is the other.
        at = cut(numbered(placed))
        size = placed.agg(F.count("*").alias("n"), F.count(F.when(F.col("side") == 1, 1)).alias("n1")).first()
        one = drawn_counts(cases, [size.n1], size.n, at, iterations, False, seed).drop("draw")
        total = _replicates(seen.groupBy("src", "dst").agg(F.sum("count").alias("all")), iterations)
        both = total.join(one, ["iter", "src", "dst"], "left").fillna(0, ["count"])
        each = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("count")), F.struct(F.lit(2).alias("side"), (F.col("all") - F.col("count")).alias("count"))))
        counts = both.select("iter", "src", "dst", each.alias("s")).select("iter", "s.side", "src", "dst", "s.count").filter("count > 0")
    counts = counts.select("iter", "side", "src", "dst", "count").union(seen.select(F.lit(0).cast("long"), "side", "src", "dst", "count"))
    w = weigh(counts, "iter", "side", kind=kind).groupBy("iter", "src", "dst").agg(F.sum(F.when(F.col("side") == 1, F.col("weight")).otherwise(-F.col("weight"))).alias("d"))
    seen = w.filter("iter = 0").select("src", "dst", F.col("d").alias("diff"))
    full = _replicates(seen, iterations).join(w, ["iter", "src", "dst"], "left").fillna(0.0, ["d"])
    found = full.groupBy("src", "dst", "diff").agg(F.try_divide(F.col("diff"), F.stddev_samp("d")).alias("effect"), ((F.sum((F.abs("d") >= F.abs("diff") - 1e-12).cast("int")) + 1) / (iterations + 1)).alias("p_value"))
    return adjust(found, correction)


#: Corrections of p values for many tests.
CORRECTIONS = ("none", "bonferroni", "holm", "hochberg", "BH", "fdr", "BY")


def adjust(p: DataFrame, method: str = "none") -> DataFrame:
    """p_value adjusted for as many tests as there are rows, one of CORRECTIONS (fdr is BH); a null stays one and is no test.

    Steps of equal p values end up equal, so rows are ranked in runs and the running least
    (or largest) step is found over the runs' own.
    """
    if method not in CORRECTIONS:
        raise ValueError(f"a correction is one of {', '.join(CORRECTIONS)}")
    if method == "none":
        return p
    told, kept = cut(p.filter("p_value is not null")), p.filter("p_value is null")
    n = told.count()
    value, rank = F.col("p_value"), F.col("__rank")
    if method == "bonferroni":
        return told.withColumn("p_value", F.least(F.lit(1.0), value * n)).unionByName(kept)
    harmonic = told.sparkSession.range(1, n + 1).agg(F.sum(1 / F.col("id")).alias("h")).first().h if method == "BY" else 1.0
    step = {"holm": value * (n + 1 - rank), "hochberg": value * (n + 1 - rank)}.get(method, value * n * (harmonic or 1.0) / rank)
    ranked = running(told, ["p_value"], name="__rank").withColumn("__step", step)
    ranked = extreme(ranked, "__rank", "__step", largest=method == "holm")
    return ranked.withColumn("p_value", F.least(F.lit(1.0), "__step")).select(*p.columns).unionByName(kept)


def extreme(ranked: DataFrame, rank: str, value: str, largest: bool, run: int = 100_000) -> DataFrame:
    """ranked with the largest value of the rows up to each in place of its own, or the least of the rows from each on."""
    pick, order = (F.max, Window.orderBy("__run")) if largest else (F.min, Window.orderBy(F.desc("__run")))
    inside = Window.partitionBy("__run").orderBy(rank if largest else F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(ranked.withColumn("__run", F.floor(F.col(rank) / run)))
    before = placed.groupBy("__run").agg(pick(value).alias("__own")).select("__run", pick("__own").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # a row a run
    both = F.greatest if largest else F.least
    return placed.join(F.broadcast(before), "__run").withColumn(value, both(pick(value).over(inside), F.col("__before"))).select(*ranked.columns)


def stability(cases: DataFrame, drops: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), iterations: int = 1000, threshold: float = 0.7, certainty: float = 0.95, seed: int = 1) -> DataFrame:
    """(measure, cs): the largest share of cases that may go while a measure still correlates: in- and out-strength and betweenness (heavy edges are short) of relative weights, loops left out.

    The networks of all drops and iterations are one disjoint union, measured together.
    """
    placed = cut(numbered(cases))
    n = placed.count()
    dropped = F.element_at(F.array(*[F.lit(float(d)) for d in drops]), F.col("draw") + 1)
    part = drawn_counts(cases, [n - int(n * d) for d in drops], n, placed, iterations, False, seed).select(dropped.alias("drop"), "iter", "src", "dst", "count")
    whole = cases.groupBy("src", "dst").agg(F.sum("count").alias("count"))

    def strengths(w: DataFrame, *keys: str) -> DataFrame:
        w = w.filter("src <> dst")
        ends = w.select(*keys, F.lit("InStrength").alias("measure"), F.col("dst").alias("node"), "weight").union(w.select(*keys, F.lit("OutStrength"), "src", "weight"))
        return ends.groupBy(*keys, "measure", "node").agg(F.sum("weight").alias("s"))

    def between(w: DataFrame, *keys: str) -> DataFrame:
        end = lambda c: F.struct(*[F.col(k) for k in keys], F.col(c).alias("at"))
        edges = cut(w.filter("src <> dst and weight > 0").select(end("src").alias("src"), end("dst").alias("dst"), "weight"))
        net = Network(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges, True)
        # A source reaches its own network only, so one batch holds networks times nodes squared.
        found = paths.betweenness(net, weighted=True, invert=True, batch=None)
        return found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.lit("Betweenness").alias("measure"), F.col("node.at").alias("node"), F.col("betweenness").alias("s"))

    def measured(w: DataFrame, *keys: str) -> DataFrame:
        w = cut(w)
        return strengths(w, *keys).unionByName(between(w, *keys))

    full, less = measured(weigh(whole)), measured(weigh(cut(part), "drop", "iter"), "drop", "iter").withColumnRenamed("s", "t")
    keys = _replicates(cases.sparkSession.createDataFrame([(float(d),) for d in drops], "drop double"), iterations)
    both = full.join(keys, how="cross").join(less, ["drop", "iter", "measure", "node"], "left").fillna(0.0, ["t"])
    cors = both.groupBy("drop", "iter", "measure").agg(pearson(F.col("s"), F.col("t")).alias("r"))
    share = cors.groupBy("measure", "drop").agg(F.avg(F.coalesce((F.col("r") >= threshold).cast("double"), F.lit(0.0))).alias("p"))
    return share.groupBy("measure").agg(F.coalesce(F.max(F.when(F.col("p") >= certainty, F.col("drop"))), F.lit(0.0)).alias("cs"))
