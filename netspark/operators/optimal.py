"""The partition of highest modularity, by exact branch and bound.

Nodes are placed one by one, neighbours of placed ones first. A row is a partial
partition; each joins every community or begins one, and a row goes on only if what it
has and the most that the rest could add exceed the best partition known. The rest adds
no more than the positive cells between unplaced nodes, and for each of them the best
community so far. All rows of a step are spread over tasks; if they become more than
`most_rows`, the search gives up with an error rather than an answer that may be wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..session import cut, shuffle_partitions
from .community import _named, _ties, louvain

#: Nodes at most: the matrix of modularity is held by every task.
MOST_NODES = 60
_ROWS = "labels binary, score double"


def _cells(net: Network, weighted: bool) -> tuple[list, np.ndarray]:
    """Node names and the symmetric matrix w_ij / 2m - k_i k_j / (2m)^2."""
    names = [r.node for r in net.nodes.select("node").orderBy("node").limit(MOST_NODES + 1).collect()]
    if len(names) > MOST_NODES:
        raise ValueError(f"optimal modularity is for {MOST_NODES} nodes at most")
    at, w = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in _ties(net, weighted).collect():  # at most MOST_NODES squared
        w[at[r.src], at[r.dst]] += r.w
    m2, k = w.sum() or 1.0, w.sum(axis=1)
    return names, w / m2 - np.outer(k, k) / (m2 * m2)


def _order(cells: np.ndarray) -> np.ndarray:
    """The node of the largest positive sum first, then always the one tied most to those before."""
    up, order = np.maximum(cells - np.diag(np.diag(cells)), 0), []
    tied = up.sum(axis=1)
    for _ in range(len(cells)):
        node = max((i for i in range(len(cells)) if i not in order), key=lambda i: (tied[i], -i))
        order.append(node)
        tied = up[:, order].sum(axis=1) + 1e-6 * up.sum(axis=1)
    return np.array(order, np.int64)


def expand(labels: np.ndarray, score: np.ndarray, cells: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Every placement of the next node that may still exceed `least`; labels: a row for each partial partition, counted up from 0 as they appear."""
    n, placed = len(cells), labels.shape[1]
    groups = labels.max(axis=1) + 1 if placed else np.zeros(len(labels), np.int64)
    most = int(groups.max(initial=0)) + 1
    member = (labels[:, :, None] == np.arange(most)).astype(float) if placed else np.zeros((len(labels), 0, most))
    tie = 2 * np.einsum("j,rjc->rc", cells[placed, :placed], member)
    row, to = np.nonzero(np.arange(most) <= groups[:, None])
    new = np.column_stack([labels[row], to])
    total = score[row] + tie[row, to]
    rest = np.arange(placed + 1, n)
    member = (new[:, :, None] == np.arange(most)).astype(float)
    held = 2 * np.einsum("ij,rjc->ric", cells[rest][:, : placed + 1], member) if len(rest) else np.zeros((len(new), 0, 1))
    between = np.maximum(cells[np.ix_(rest, rest)], 0)
    bound = total + np.maximum(held.max(axis=2), 0).sum(axis=1) + between.sum() - np.trace(between)
    go = bound > least + 1e-12
    return new[go], total[go]


def optimal(net: Network, weighted: bool = True, most_rows: int = 5_000_000, start: DataFrame | None = None) -> DataFrame:
    """(node, community) of the highest modularity there is; start: (node, community), a good partition to begin with (Louvain's, if none)."""
    names, cells = _cells(net, weighted)
    if not names:
        return net.nodes.select("node", F.col("node").alias("community"))
    known = {r.node: r.community for r in (louvain(net, weighted) if start is None else start).select("node", "community").collect()}  # at most MOST_NODES
    order = _order(cells)
    cells, named = cells[np.ix_(order, order)], [names[i] for i in order]
    loops = float(np.trace(cells))
    first = np.array([known[n] for n in named], object)
    least = float(cells[first[:, None] == first[None, :]].sum()) - loops
    spark, best = net.nodes.sparkSession, None
    rows = spark.createDataFrame([(b"", 0.0)], _ROWS)
    for step in range(len(named)):

        def grow(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    part = batch.slice(low, 2000)
                    labels = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, step).astype(np.int64)
                    new, score = expand(labels, part.column(1).to_numpy(), cells, least)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in new.astype(np.uint8)], pa.binary()), pa.array(score)], names=["labels", "score"])

        rows = cut(rows.mapInArrow(grow, _ROWS), rows)
        n = rows.count()
        if not n:
            break
        if n > most_rows:
            raise RuntimeError(f"more than {most_rows} partial partitions after {step + 1} of {len(named)} nodes")
        if n > 1000:
            rows = rows.repartition(shuffle_partitions(spark))
    else:
        best = rows.orderBy(F.desc("score"), "labels").first()
    labels = first if best is None else np.frombuffer(best.labels, np.uint8)
    placed = spark.createDataFrame([(n, str(c)) for n, c in zip(named, labels, strict=True)], f"node {net.nodes.schema['node'].dataType.simpleString()}, community string")
    return _named(placed)
