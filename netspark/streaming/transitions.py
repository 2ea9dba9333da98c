"""Transition counts over a stream of events: the last state of each case is all the state there is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def stream_transitions(events: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """(src, dst), a row a transition, from a stream of rows (case, t, state).

    Rows of a case within a micro-batch are put in order of t; rows older than
    the last one seen of their case count from the state as it stands. A case
    without rows for the timeout (processing time) is forgotten.
    """
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("t")
        last = state.get[0] if state.exists else None
        before = [last, *rows["state"].tolist()[:-1]]
        pairs = pd.DataFrame({"src": before, "dst": rows["state"].tolist()})
        state.update((rows["state"].iloc[-1],))
        state.setTimeoutDuration(wait)
        yield pairs.dropna()

    return events.groupBy("case").applyInPandasWithState(step, "src string, dst string", "last string", "append", "ProcessingTimeTimeout")


def count_into(pairs: DataFrame, table: str):
    """Starts the query that appends each micro-batch's counts to a table, a row (src, dst, count) a pair and batch."""
    from pyspark.sql import functions as F

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("src", "dst").agg(F.count("*").alias("count")).withColumn("batch", F.lit(number)).write.mode("append").saveAsTable(table)

    return pairs.writeStream.foreachBatch(write).outputMode("append").start()
