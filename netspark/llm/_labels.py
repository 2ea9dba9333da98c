"""Labelled rows for the classifiers: a bounded, reproducible sample, without the held-out quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], list[int]]:
    """Whole texts and 0/1 labels of at most `most` labelled documents outside the held-out quarter, the first by a hash of their id.

    The ids are chosen on the labels alone, so only the chosen texts travel.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").collect()  # bounded by `most`
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [int(r.y) for r in rows]
