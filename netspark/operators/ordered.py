"""Row numbers and running totals over a whole table, without one task that holds it.

The table is sorted by ranges into runs; a window in each run and the totals of the runs
before it give every row's place. Runs are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running(df: DataFrame, order: list[str], value: str | None = None, name: str = "upto") -> DataFrame:
    """df with the sum of a column up to each row (itself included), or with row numbers from 1.

    order names columns (those of equal rows decide nothing); nulls come first.
    """
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__run_at", F.monotonically_increasing_id())
    runs = cut(runs.withColumn("__run", F.shiftright("__run_at", 33)))
    one: Column = F.col(value) if value else F.lit(1).cast("long")
    totals = runs.groupBy("__run").agg(F.sum(one).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))  # a row a run
    starts = F.broadcast(totals.select("__run", F.coalesce(before, F.lit(0)).alias("__before")))
    within = F.sum(one).over(Window.partitionBy("__run").orderBy("__run_at").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("__within", within).join(starts, "__run").select(*df.columns, (F.col("__before") + F.col("__within")).alias(name))
