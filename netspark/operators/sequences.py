"""Ordered events to transition networks: rows (case, t, state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_wide(wide: DataFrame, case: str, steps: list[str]) -> DataFrame:
    """(case, t, state) from a row a case and a column a time point, t from 1."""
    long = wide.select(F.col(case).alias("case"), F.explode(F.array(*[F.struct(F.lit(i + 1).alias("t"), F.col(c).alias("state")) for i, c in enumerate(steps)])).alias("x"))
    return long.select("case", "x.t", "x.state")


def steps(seq: DataFrame) -> DataFrame:
    """(case, src, dst): neighbouring pairs; a pair with a null state is none."""
    order = Window.partitionBy("case").orderBy("t")
    return seq.select("case", F.col("state").alias("src"), F.lead("state").over(order).alias("dst")).filter("src is not null and dst is not null")


def case_transitions(seq: DataFrame) -> DataFrame:
    """(case, src, dst, count), the unit of all resampling."""
    return steps(seq).groupBy("case", "src", "dst").agg(F.count("*").alias("count"))


def relative(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts with weight = share of all that leave src (within the keys)."""
    return counts.withColumn("weight", F.col("count") / F.sum("count").over(Window.partitionBy(*keys, "src")))


def transition_network(seq: DataFrame) -> DataFrame:
    """(src, dst, count, weight)."""
    return relative(steps(seq).groupBy("src", "dst").agg(F.count("*").alias("count")))


def initial_states(seq: DataFrame) -> DataFrame:
    """(state, count, share) of the cases' first states that are not null."""
    first = seq.filter("state is not null").groupBy("case").agg(F.min_by("state", "t").alias("state"))
    counts = first.groupBy("state").agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def windows(seq: DataFrame, size: int, step: int, length: int | None = None) -> DataFrame:
    """(window, case, t, state): ordinal windows of `size` time points, a start every `step`, within 1 .. length; without a length, to the last time point that any case has."""
    seq = seq.crossJoin(F.broadcast(seq.agg(F.max("t").alias("length")))) if length is None else seq.withColumn("length", F.lit(length))
    last = F.floor((F.col("length") - size) / step)
    low = F.greatest(F.ceil((F.col("t") - size) / step), F.lit(0)).cast("int")
    high = F.least(F.floor((F.col("t") - 1) / step), last).cast("int")
    return seq.filter((F.col("t") >= 1) & (F.col("t") <= F.col("length"))).withColumn("lo", low).withColumn("hi", high).filter("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("window"), "case", "t", "state")


def window_transitions(seq: DataFrame, size: int = 5, step: int = 1, length: int | None = None, na_threshold: float | None = 0.5) -> DataFrame:
    """(window, src, dst, count, weight) of each window; the series ends before the first window with too many nulls (None: never)."""
    if size < 2 or step < 1:
        raise ValueError("a window has two time points at least, and starts are one apart at least")
    w = windows(seq, size, step, length)
    if na_threshold is not None:
        w = w.join(F.broadcast(usable_windows(seq, size, step, length, na_threshold).filter("usable").select("window")), "window", "left_semi")  # a row a window
    order = Window.partitionBy("window", "case").orderBy("t")
    pairs = w.select("window", F.col("state").alias("src"), F.lead("state").over(order).alias("dst")).filter("src is not null and dst is not null")
    return relative(pairs.groupBy("window", "src", "dst").agg(F.count("*").alias("count")), "window")


def usable_windows(seq: DataFrame, size: int = 5, step: int = 1, length: int | None = None, na_threshold: float = 0.5) -> DataFrame:
    """(window, na_share, usable) of every window: the share of nulls among all cells of the table with a row for each case and a column for each time point.

    Cells after a case's end are null too. The first window above the threshold ends the series.
    """
    whole = seq.agg(F.max("t").alias("last"), F.countDistinct("case").alias("cases"))
    last = F.floor(((F.lit(length) if length else F.col("last")) - size) / step).cast("int")
    every = whole.filter(last >= 0).select(F.explode(F.sequence(F.lit(0), last)).alias("window"), "cases")
    told = windows(seq.filter("state is not null"), size, step, length) if length else windows(seq, size, step).filter("state is not null")
    share = every.join(told.groupBy("window").agg(F.count("*").alias("n")), "window", "left").select("window", (1 - F.coalesce("n", F.lit(0)) / (F.col("cases") * size)).alias("na_share"))
    first = share.filter(F.col("na_share") > na_threshold).agg(F.min("window").alias("first"))
    return share.join(F.broadcast(first), how="cross").select("window", "na_share", (F.col("first").isNull() | (F.col("window") < F.col("first"))).alias("usable"))


def cooccurrence(marks: DataFrame) -> DataFrame:
    """(src, dst, count) with src <= dst: windows in which both codes stand; marks (window, code). The diagonal counts windows with the code."""
    m = marks.select("window", "code").distinct()
    return m.alias("a").join(m.alias("b"), (F.col("a.window") == F.col("b.window")) & (F.col("a.code") <= F.col("b.code"))).groupBy(F.col("a.code").alias("src"), F.col("b.code").alias("dst")).agg(F.count("*").alias("count"))


def code_transitions(marks: DataFrame) -> DataFrame:
    """(src, dst, count): codes of a window followed by codes of the next one (window is consecutive within actor); marks (actor, window, code)."""
    m = marks.select("actor", "window", "code").distinct()
    return m.alias("a").join(m.alias("b"), (F.col("a.actor") == F.col("b.actor")) & (F.col("b.window") == F.col("a.window") + 1)).groupBy(F.col("a.code").alias("src"), F.col("b.code").alias("dst")).agg(F.count("*").alias("count"))


def flows(seq: DataFrame, min_flow: int = 1) -> DataFrame:
    """(step, src, dst, count): the cross-table of each time point with the next."""
    order = Window.partitionBy("case").orderBy("t")
    pairs = seq.select(F.col("t").alias("step"), F.col("state").alias("src"), F.lead("state").over(order).alias("dst"), F.lead("t").over(order).alias("next")).filter("src is not null and dst is not null and next = step + 1")
    return pairs.groupBy("step", "src", "dst").agg(F.count("*").alias("count")).filter(F.col("count") >= min_flow)


def node_positions(totals: DataFrame, spacing: float = 0.0) -> DataFrame:
    """(step, state, count, bottom, top): bars stacked downward in the order of the states, the whole stack centred on 0.5."""
    before, every = Window.partitionBy("step").orderBy("state").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("step")
    start = 0.5 + (F.sum("count").over(every) + spacing * (F.count("*").over(every) - 1)) / 2
    top = start - F.coalesce(F.sum("count").over(before), F.lit(0)) - spacing * F.count("*").over(before)
    return totals.withColumn("top", top.cast("double")).withColumn("bottom", F.col("top") - F.col("count")).select(*totals.columns, "bottom", "top")


def trajectories(seq: DataFrame) -> DataFrame:
    """(case, first, last, steps): where each case begins and ends."""
    return seq.filter("state is not null").groupBy("case").agg(F.min_by("state", "t").alias("first"), F.max_by("state", "t").alias("last"), F.count("*").alias("steps"))
