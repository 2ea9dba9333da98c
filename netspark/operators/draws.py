"""Draws of cases, split down a tree of blocks of cases, so that no row for a case and a draw is made.

Cases stand in blocks of BLOCK. How many of a draw's cases fall into the left half of the
blocks is one number: binomial if cases are put back, hypergeometric if not; so on down to
a block. Each block draws the numbers on its own way from the root, whose generators are
seeded by the node of the tree, so that all blocks below a node agree on them without
asking each other. A block then draws among its own cases and adds up their counts; what is
shuffled is a row for a block, a draw and an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Cases of a block.
BLOCK = 1024
#: Draws that a block holds at once, as arrays of draws times its cases or rows.
AT_ONCE = 64


def numbered(cases: DataFrame, parts: int = 1024) -> DataFrame:
    """(case, at): different cases numbered from 0, part after part, so that no task sorts them all."""
    placed = cases.select("case").distinct().withColumn("part", F.pmod(F.xxhash64("case"), F.lit(parts)))
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("case")) - 1)
    return ranked.join(F.broadcast(before), "part").select("case", (F.col("before") + F.col("r")).alias("at"))


def fall(block: int, n: int, size: int, draws: np.ndarray, back: bool, seed: int) -> np.ndarray:
    """How many cases each draw takes from a block of `size` of n cases; draws: how many it takes of all."""
    low, high, taken = 0, -(-n // size), draws
    while high - low > 1:
        mid = (low + high) // 2
        left, right = min(n, mid * size) - low * size, min(n, high * size) - mid * size
        rng = np.random.default_rng([seed, low, high])
        part = rng.binomial(taken, left / (left + right)) if back else rng.hypergeometric(left, right, taken)
        low, high, taken = (low, mid, part) if block < mid else (mid, high, taken - part)
    return taken


def within(taken: np.ndarray, cases: int, back: bool, rng: np.random.Generator) -> np.ndarray:
    """(draw, case): how often each of a block's cases stands in each draw."""
    if back:
        return rng.multinomial(taken, np.full(cases, 1 / cases))
    ranks = rng.random((len(taken), cases)).argsort(axis=1).argsort(axis=1)
    return (ranks < taken[:, None]).astype(np.int64)


def drawn_counts(cases: DataFrame, sizes: list[int], n: int, placed: DataFrame, iterations: int, back: bool, seed: int) -> DataFrame:
    """(draw, iter, src, dst, count): counts of the edges of the cases drawn, without zeros.

    cases (case, src, dst, count); placed (case, at) as of `numbered`, n of them. Draw i
    takes sizes[i] cases, with return (back) or without, in each of the iterations from 1.
    """
    told = np.repeat(np.asarray(sizes, dtype=np.int64), iterations)
    fields = cases.select("src", "dst").schema.fields
    made = StructType([StructField("turn", LongType()), *fields, StructField("count", LongType())])

    def draw(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        block = int(rows["at"].iloc[0]) // BLOCK
        inside = min(n, (block + 1) * BLOCK) - block * BLOCK
        edge, keys = pd.MultiIndex.from_frame(rows[["src", "dst"]]).factorize()
        order = np.argsort(edge, kind="stable")
        at, count = rows["at"].to_numpy()[order] - block * BLOCK, rows["count"].to_numpy(dtype=np.int64)[order]
        starts = np.searchsorted(edge[order], np.arange(len(keys)))
        taken = fall(block, n, BLOCK, told, back, seed)
        rng = np.random.default_rng([seed, block, 1, 1])
        for first in range(0, len(told), AT_ONCE):
            times = within(taken[first : first + AT_ONCE], inside, back, rng)
            sums = np.add.reduceat(times[:, at] * count, starts, axis=1)
            turn, which = np.nonzero(sums)
            yield pd.DataFrame({"turn": turn + first, "src": keys.get_level_values(0).take(which), "dst": keys.get_level_values(1).take(which), "count": sums[turn, which]})

    def block_of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(draw(rows)), ignore_index=True)

    blocked = cases.join(placed, "case").select(F.floor(F.col("at") / BLOCK).alias("block"), "at", "src", "dst", "count")
    found = blocked.groupBy("block").applyInPandas(block_of, made).groupBy("turn", "src", "dst").agg(F.sum("count").alias("count"))
    return found.select(F.floor(F.col("turn") / iterations).cast("int").alias("draw"), (F.col("turn") % iterations + 1).alias("iter"), "src", "dst", "count")
