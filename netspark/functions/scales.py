"""Values to sizes, widths, colours and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running


def scale_size(df: DataFrame, value: str, low: float = 0.03, high: float = 0.1, trans: str = "linear", name: str = "size") -> DataFrame:
    """df with a column from low to high by the least and largest value, after sqrt or log1p; the middle without spread."""
    v = {"linear": F.col(value), "sqrt": F.sqrt(F.greatest(value, F.lit(0.0))), "log": F.log1p(value)}[trans]
    span = F.broadcast(df.agg(F.min(v).alias("__low"), F.max(v).alias("__high")))  # one row
    share = F.try_divide(v - F.col("__low"), F.col("__high") - F.col("__low"))
    return df.join(span, how="cross").withColumn(name, F.coalesce(low + (high - low) * share, F.lit((low + high) / 2))).drop("__low", "__high")


def scale_edge_widths(df: DataFrame, weight: str = "weight", mode: str = "linear", low: float = 0.5, high: float = 4.0, minimum: float = 0.0, maximum: float | None = None, name: str = "width") -> DataFrame:
    """df with |weight| brought to low .. high: its ratio to the maximum, that of logarithms or roots, or the mean rank.

    Ranks are those of the different weights, so edges are only counted.
    """
    w = F.abs(F.col(weight))
    if mode == "rank":
        counts = df.select(w.alias("__w")).filter("__w is not null").groupBy("__w").agg(F.count("*").alias("__n"))
        ranks = running(counts, ["__w"], "__n", "__upto")
        every = F.broadcast(df.agg(F.count("*").alias("__all")))
        share = F.try_divide(F.col("__upto") - F.col("__n") + (F.col("__n") - 1) / 2, F.col("__all") - 1)
        made = df.join(ranks, w == F.col("__w"), "left").join(every, how="cross")
    else:
        f = {"linear": lambda x: x, "log": F.log1p, "sqrt": F.sqrt}[mode]
        top = df.agg(F.max(w).alias("__top")) if maximum is None else df.sparkSession.range(1).select(F.lit(float(maximum)).alias("__top"))
        made, share = df.join(F.broadcast(top), how="cross"), F.try_divide(f(w), f(F.col("__top")))
    share = F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return made.select(*df.columns, F.when(F.col(weight).isNull() | (w < minimum), low).otherwise(low + (high - low) * share).alias(name))


def adaptive_edge_size(n_nodes: int, directed: bool = False) -> float:
    size = 4 * math.exp(-n_nodes / 150) + 1.5
    return max(1.0, 0.7 * size) if directed else size


def curvatures(edges: DataFrame, curve: float = 0.0, default: float = 0.2) -> DataFrame:
    """Edges with a column curve: where the given one is 0, an edge whose other direction is there too takes the default."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(default).alias("__back")).distinct()
    both = edges.join(back, ["src", "dst"], "left")
    made = both.withColumn("curve", F.lit(float(curve)) if curve else F.coalesce("__back", F.lit(0.0)))
    return made.select(*[c for c in edges.columns if c != "curve"], "curve")


def edge_color(weight: Column, positive: str = "#2E7D32", negative: str = "#C62828", zero: str = "gray50") -> Column:
    return F.when(weight > 0, positive).when(weight < 0, negative).otherwise(zero)


def stars(p: Column) -> Column:
    """*** below 0.001, ** below 0.01, * below 0.05, else nothing."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def format_p(p: Column, digits: int = 3, prefix: str = "p=") -> Column:
    small = 10.0**-digits
    return F.when(p < small, F.concat(F.lit(prefix[:-1] + "<"), F.format_number(F.lit(small), digits))).otherwise(F.concat(F.lit(prefix), F.format_number(p, digits)))


def format_range(low: Column, high: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("["), F.format_number(low, digits), F.lit(", "), F.format_number(high, digits), F.lit("]"))
