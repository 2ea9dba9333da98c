"""Merkle manifest of a dataset in an external-memory node store (operator 13).

A leaf is the digest of a row's fields. The leaves of a group (a language) ascend by id;
`FANOUT` consecutive nodes become the digest of their digests, level by level, until one
is left. The groups' last nodes, in the groups' order, are the leaves of one more tree,
whose last node is the root.

* Leaves are sorted by ranges of (group, id) and stored in these runs. How many rows of a
  group a run holds, summed over the runs before, places every leaf in its group.
* Levels are Parquet folders `level=k` of one store. A level is made by reading the one
  below as it lies: sequences of FANOUT neighbours inside a stream become parents at once,
  and only the pieces at the ends of streams meet in a shuffle.
* Proofs come down the levels: the node groups of a level merge by coordinate (group,
  position / FANOUT) with the proofs of the level above, FANOUT rows to one at most, so
  no coordinate is hot and the top of the tree meets no leaf. A proof is the list of a
  node's siblings, left and right, from its own level to the root.

Texts are hashed where they are read and never shuffled. State is some 200 bytes a row.

Every row is a leaf, repeated rows and rows that share an id too (equal ids go by their
digests). Null ids stand first in their group, the null group before all others; null
fields have a mark of their own, so they differ from empty texts. Empty tables give empty
results and no root. Texts of any length are digested whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard, shared_folder, small

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(c) for c in fields.values()]))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ..) in sorted runs, with `pos`, the place in the tree by this order, and `width`, how many nodes the tree has.

    The runs are stored, so that a place is the same whoever reads it.
    """
    runs = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    runs = cut(runs.withColumn("run", F.shiftright("at", 33)))
    held = runs.groupBy("run", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("width", F.sum("n").over(Window.partitionBy("tree")))
    starts = small(cut(starts.select("run", "tree", (F.col("before") - F.col("first")).alias("shift"), "width")))
    return runs.join(starts, ["run", "tree"]).select("tree", (F.col("at") + F.col("shift")).alias("pos"), "width", *[c for c in nodes.columns if c != "tree"])


# --- levels -------------------------------------------------------------------------

_PARTS = "tree string, parent long, width long, whole boolean, pos array<long>, digests array<string>"


def _parts(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    """(tree, parent, width, whole, pos, digests) of neighbouring children in a stream of (tree, pos, width, digest).

    A part is whole if it has all children of its parent; then `digests` holds the parent's digest.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).dictionary_encode()
        code = tree.indices.to_numpy(zero_copy_only=False)
        pos, width = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        parent = pos // fanout
        new = np.append(True, (code[1:] != code[:-1]) | (parent[1:] != parent[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(pos)))
        whole = size == np.minimum(fanout, width[head] - parent[head] * fanout)
        at, digests = pos.tolist(), batch.column(3).to_pylist()
        made = [[hashlib.sha256("".join(d for _, d in sorted(zip(at[a : a + n], digests[a : a + n], strict=True))).encode()).hexdigest()] if w else digests[a : a + n] for a, n, w in zip(head.tolist(), size.tolist(), whole.tolist(), strict=True)]
        places = [[] if w else at[a : a + n] for a, n, w in zip(head.tolist(), size.tolist(), whole.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(head)), pa.array(parent[head], pa.int64()), pa.array(width[head], pa.int64()), pa.array(whole), pa.array(places, pa.list_(pa.int64())), pa.array(made, pa.list_(pa.string()))],
            names=["tree", "parent", "width", "whole", "pos", "digests"],
        )


def level_above(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes above a level (tree, pos, width, digest) of the trees that go on."""
    parts = cut(level.filter("width > 1").select("tree", "pos", "width", "digest").mapInArrow(lambda b: _parts(b, fanout), _PARTS))
    above = F.ceil(F.col("width") / fanout).alias("width")
    inside = parts.filter("whole").select("tree", F.col("parent").alias("pos"), above, F.col("digests")[0].alias("digest"))
    pieces = parts.filter("not whole").select("tree", "parent", "width", F.explode(F.arrays_zip("pos", "digests")).alias("child"))
    met = pieces.groupBy("tree", "parent", "width").agg(F.array_sort(F.collect_list("child")).alias("run"))
    glued = met.select("tree", F.col("parent").alias("pos"), above, digest(F.array_join(F.transform("run", lambda x: x["digests"]), "")).alias("digest"))
    return inside.union(glued)


@dataclass(frozen=True)
class Trees:
    """Level k of all trees is levels[k]: (tree, pos, width, digest), level 0 with what else belongs to a leaf."""

    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """(tree, digest): the last node of every tree."""
        out = [level.filter("width = 1").select("tree", "digest") for level in self.levels]
        made = out[0]
        for more in out[1:]:
            made = made.union(more)
        return made


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(leaves: DataFrame, path: str, fanout: int = FANOUT) -> Trees:
    """All levels over leaves (tree, pos, width, digest, ..), stored as `level=k` below the path."""
    levels = [_store(leaves.sortWithinPartitions("tree", "pos"), f"{path}/level=0")]
    while not levels[-1].filter("width > 1").isEmpty():
        levels.append(_store(level_above(levels[-1], fanout).sortWithinPartitions("tree", "pos"), f"{path}/level={len(levels)}"))
    return Trees(levels, fanout)


def prove(trees: Trees, tops: DataFrame) -> DataFrame:
    """The leaves with `proof`, their siblings on the way up, and the columns of `tops` (tree, proof, ..); tops go on above the trees."""
    carried = [c for c in tops.columns if c not in ("tree", "proof")]
    found = None
    for number in range(len(trees.levels) - 1, -1, -1):
        level = trees.levels[number]
        own = [c for c in level.columns if c not in ("tree", "pos", "width", "digest")]
        last = level.filter("width = 1").join(tops, "tree").select("tree", "pos", "digest", *own, "proof", *carried)
        if found is not None:
            groups = level.filter("width > 1").groupBy("tree", F.floor(F.col("pos") / trees.fanout).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *own))).alias("run"))
            above = found.select("tree", F.col("pos").alias("parent"), "proof", *carried)
            each = groups.join(above, ["tree", "parent"]).select("tree", "proof", *carried, "run", F.posexplode("run").alias("i", "x"))
            beside = lambda a, n: F.array_join(F.transform(F.slice("run", a, n), lambda y: y["digest"]), "")
            step = F.struct(beside(F.lit(1), F.col("i")).alias("left"), beside(F.col("i") + 2, F.size("run")).alias("right"))
            below = each.select("tree", "x.pos", "x.digest", *[F.col(f"x.{c}") for c in own], F.concat(F.array(step), "proof").alias("proof"), *carried)
            last = last.union(below)
        found = last
    return found


def siblings(proof: Column) -> Column:
    """All siblings of a proof in their order, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def fold(own: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, own, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, and the tree over their roots."""

    groups: Trees
    over: Trees

    def root(self) -> str | None:
        """The digest of the whole dataset."""
        found = self.over.roots().first()
        return found.digest if found else None

    def proofs(self) -> DataFrame:
        """Every row's leaf with `subroot`, `root` and `proof`, and what was stored beside the leaf; `tree` names the group."""
        root = self.over.roots().select("tree", F.array().cast(STEP).alias("proof"), F.col("digest").alias("root"))
        tops = prove(self.over, root).select(F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
        return prove(self.groups, tops).withColumnRenamed("digest", "leaf").drop("pos")


def manifest(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None, path: str | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table with a `doc_id`, stored below the path (a folder that goes with the driver, if none is named).

    also: columns of the rows that are stored beside their leaves.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("tree")  # the null group before all others
    leaves = cut(docs.select(tree, "doc_id", leaf({c: F.col(c) for c in fields}).alias("digest"), *[c.alias(n) for n, c in (also or {}).items()]))
    groups = build(placed(leaves, ["doc_id", "digest"]), f"{path}/rows", fanout)
    discard(leaves)
    tops = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    return Manifest(groups, build(placed(tops, ["of"]), f"{path}/groups", fanout))
