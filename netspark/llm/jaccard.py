"""Exact n-gram Jaccard join with signature trees (operator 7).

Documents whose sets of word shingles reach a Jaccard similarity of 0.75 link;
each gets the least doc_id that links lead to. The work narrows in three steps:

1. Equal sets form classes, by digest. Every second shingle (by a bit of its hash)
   is exchanged in packed rows: its upper 48 bits, and which class it is of. A
   class can miss at most a quarter of its shingles in any partner, and a partner
   is at most a third larger or a quarter smaller. So a shingle counts as shared
   if a class of such a size has it too, and a class with more exchanged shingles
   that are not shared than it may miss cannot link and is done.
2. The others order their shingles by how many of them have it, rarest first.
   Linked sets share one of their first quarter (prefix filter), and shingles that
   only one set has need no look. Each class goes to the groups of a few of the
   rest; in a group a signature tree holds OR-combined bitmaps of the sets and
   ranges of their sizes, and a dual traversal meets only those node pairs whose
   largest possible overlap suffices. Pairs are verified on the sets; what is
   connected already is skipped. This collapses groups of near copies, and their
   components go on as stars.
3. Groups of any shared prefix shingle that still hold two components are
   traversed with signatures and, where they are short, the sets themselves,
   which are verified there; other surviving pairs across components are verified
   by joining the sets.

Large groups are dealt out in chunks, in the last step in all pairs of chunks.
No step drops a link by its size or its group's. Sets compare by 64-bit hashes of
shingles, 48 of these bits and 64 bits of a class's digest stand for them in the
first step; two shingles that merge there only keep more classes, two classes that
merge (a chance of one in 10^7 with a million classes) could hide a link.

Null texts and texts without words have empty sets and link with nothing; a null
doc_id links with nothing and has no component; rows of one doc_id with different
texts are judged each by its own text (a class is named by its least doc_id and
its digest, so one id can name several); texts of any length are taken whole;
empty tables give empty results; extra columns are carried by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, discard, shuffle_partitions, small
from . import _exchange as ex
from . import _words

SHINGLE = 5
#: A link needs NUM / DEN of the union.
NUM, DEN = 3, 4
#: Members of a group that are compared among themselves at once: in the second
#: step, where larger groups are dealt out anew each time, and in the third.
SALTED, CHUNK = 500, 2000
#: Groups that each class's set is sent to in the second step.
SENT = 2
LEAF, FAN = 4, 4
#: Sets of at most so many shingles travel whole into the third step.
WHOLE = 256
#: Bytes of texts whose keys leave in one set of packed rows, and of keys that meet in one task.
SENT_BYTES, PART_BYTES = 8 << 20, 32 << 20
U64 = np.uint64


def shingle_sets(words: _words.Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; fewer than k words make one shingle."""
    grams = _words.grams(words.hash, k)
    out = []
    for a, e in zip(words.first[:-1], words.first[1:], strict=True):
        if e - a >= k:
            out.append(np.unique(grams[a : e - k + 1]))
        elif e > a:
            out.append(_words.grams(words.hash[a:e], int(e - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


# --- signatures and trees ---------------------------------------------------


def signature_bits(n: int) -> int:
    """Bits of a set's bitmap: four a shingle, within 1024 and 16384, a power of two."""
    return min(16384, max(1024, 1 << (4 * n - 1).bit_length()))


def signature(shingles: np.ndarray) -> np.ndarray:
    bits = signature_bits(len(shingles))
    at = np.unique((shingles & U64(bits - 1)).astype(np.int64))
    out = np.zeros(bits // 64, U64)
    np.bitwise_or.at(out, at >> 6, U64(1) << (at & 63).astype(U64))
    return out


def _fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


class SignatureTree:
    """Sets under nodes of OR-combined bitmaps, size ranges and slack.

    A set's slack is its size less the bits that it sets, so two sets share at
    most the bits that they have in common and the smaller slack. Sets stand in
    the order of their size to a third, then of the lowest and highest bit that
    they set (min-hashes, in effect), so that like sets share a node and its
    bitmap stays sparse.
    """

    def __init__(self, sizes: np.ndarray, signatures: list[np.ndarray]):
        words = min(len(s) for s in signatures)
        bits = np.stack([_fold(s, words) for s in signatures])
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(DEN / NUM)).astype(np.int64)
        flat = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
        self.order = np.lexsort((flat[:, ::-1].argmax(1), flat.argmax(1), band))
        self.bits = bits[self.order]
        self.sizes = sizes[self.order]
        self.slack = self.sizes - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        # Levels from the leaves upward: bitmap, least and largest size, largest slack.
        cuts = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(self.bits, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.slack, cuts))
        self.levels = [level]
        while len(level[1]) > 1:
            cuts = np.arange(0, len(level[1]), FAN)
            level = (np.bitwise_or.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)

    @staticmethod
    def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
        """Which node pairs (i of a, j of b) can hold a link."""
        keep = (DEN * a[2][i] >= NUM * b[1][j]) & (DEN * b[2][j] >= NUM * a[1][i])
        near = np.flatnonzero(keep)
        for at in range(0, len(near), 1 << 12):  # bitmaps of a few thousand pairs at once
            part = near[at : at + (1 << 12)]
            x, y = i[part], j[part]
            most = np.bitwise_count(a[0][x] & b[0][y]).sum(1).astype(np.int64) + np.minimum(a[3][x], b[3][y])
            keep[part] = (NUM + DEN) * most >= NUM * (a[1][x] + b[1][y])
        return keep

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that survive the traversal of this tree with itself."""
        i = j = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = self.may_link(level, i, level, j)
            i, j = i[keep], j[keep]
            if depth:
                n = len(self.levels[depth - 1][1])
                kids = np.arange(FAN)
                i, j = np.broadcast_to((i[:, None] * FAN + kids)[:, :, None], (len(i), FAN, FAN)).ravel(), np.broadcast_to((j[:, None] * FAN + kids)[:, None, :], (len(j), FAN, FAN)).ravel()
                keep = (i <= j) & (i < n) & (j < n)
                i, j = i[keep], j[keep]
        return i, j

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of members (by position in the given lists) that may link, some thousands at a time."""
        every = (self.bits, self.sizes, self.sizes, self.slack)
        n, at = len(self.sizes), np.arange(LEAF)
        left, right = self.leaf_pairs()
        step = (1 << 16) // LEAF**2
        for s in range(0, len(left), step):
            x, y = left[s : s + step, None] * LEAF + at, right[s : s + step, None] * LEAF + at
            i, j = np.repeat(x, LEAF, 1).ravel(), np.tile(y, LEAF).ravel()
            keep = (i < j) & (j < n)
            i, j = i[keep], j[keep]
            keep = self.may_link(every, i, every, j)
            yield self.order[i[keep]], self.order[j[keep]]

    def tested(self) -> tuple[int, int]:
        """Pairs of sets in the leaf pairs that the traversal lets through, and all pairs."""
        n = len(self.sizes)
        return min(len(self.leaf_pairs()[0]) * LEAF**2, n * (n - 1) // 2), n * (n - 1) // 2


class Forest:
    """Union-find over the members of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def group_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among these sets (a spanning forest)."""
    forest, out = Forest(len(sets)), []
    tree = SignatureTree(np.array([len(s) for s in sets]), [signature(s) for s in sets])
    for left, right in tree.pairs():
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            if forest.root(i) != forest.root(j) and linked(sets[i], sets[j]):
                forest.join(i, j)
                out.append((i, j))
    return out


# --- first step: classes, and which of them can link at all -----------------

_KEYS = "part int, keys binary, entry binary, tags binary, sizes binary, needs binary"
_COUNTS = "part int, tags binary, shared binary, needs binary"


def tag_of(class_: bytes) -> int:
    """The class in 64 bits."""
    return int.from_bytes(class_[:8], "big", signed=True)


def need_of(n, sent):
    """How many of a class's exchanged shingles must be shared if it is to link: it may miss a quarter of all."""
    return -(-NUM * n // DEN) - (n - sent)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for piece in _words.slices(batch, batch.schema.names[text]):
            yield piece, shingle_sets(_words.split(piece.column(text), _words.SPACED_LOWER))


def with_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, class, n, sent) of every document: hash of its text, digest and size of its set, and how much of it is exchanged."""
    schema = docs.select("doc_id").schema.add("mark", "long").add("class", "binary").add("n", "long").add("sent", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(exchanged(s).sum()) for s in sets], pa.int64())], names=["doc_id", "mark", "class", "n", "sent"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, schema)


def exchanged(keys: np.ndarray) -> np.ndarray:
    """Which shingles the first step exchanges; the same ones wherever they are."""
    return keys & U64(1) == 0


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "part" else pa.binary()) for n, c in zip(names, columns, strict=True)], names=names)


def _key_rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    def sent(sets: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        keys = np.concatenate([x for x, _, _ in sets])
        tags, size = np.array([t for _, t, _ in sets], np.int64), np.array([n for _, _, n in sets], np.int64)
        count = np.array([len(x) for x, _, _ in sets], np.int64)
        need = np.maximum(need_of(size, count), 0)
        row = np.repeat(np.arange(len(sets), dtype=np.int32), count)
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        out = []
        for part, a, e in ex.cuts(keys, parts):
            which, entry = np.unique(row[a:e], return_inverse=True)
            out.append((part, ex.pack_sorted(keys[a:e] >> U64(16)), ex.pack_small(entry), tags[which].tobytes(), ex.pack_small(size[which]), ex.pack_small(need[which])))
        return _packed(out, _KEYS)

    held, size = [], 0
    for piece, sets in _slices(batches, 0):
        held += [(x[exchanged(x)], tag_of(digest(x)), len(x)) for x in sets if len(x)]
        size += piece.nbytes
        if size >= SENT_BYTES and held:
            yield sent(held)
            held, size = [], 0
    if held:
        yield sent(held)


def _shared_counts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each class with keys in this part: how many of them another class has whose size allows a link; packed by ranges of tags."""
    keys, entry, tags, sizes, needs, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        for k, e, t, s, d in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("keys", "entry", "tags", "sizes", "needs")], strict=True):
            keys.append(ex.unpack_sorted(k.as_py()))
            entry.append(ex.unpack_small(e.as_py()) + n)
            tags.append(np.frombuffer(t.as_py(), np.int64))
            sizes.append(ex.unpack_small(s.as_py()))
            needs.append(ex.unpack_small(d.as_py()))
            n += len(tags[-1])
    tag, size, need = np.concatenate(tags), np.concatenate(sizes), np.concatenate(needs)
    # Classes in the order of size; copies of one class become one.
    order = np.lexsort((tag, size))
    new = np.ones(len(order), bool)
    new[1:] = (tag[order][1:] != tag[order][:-1]) | (size[order][1:] != size[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    tag, size, need = tag[order][new], size[order][new], need[order][new]
    key, of = np.concatenate(keys), rank[np.concatenate(entry)]
    order = np.lexsort((of, key))
    key, of = key[order], of[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[once], of[once]
    # In a key's classes by size, the nearest neighbours are the likeliest partners.
    meets = (key[1:] == key[:-1]) & (DEN * size[of[:-1]] >= NUM * size[of[1:]])
    shared = np.zeros(len(key), bool)
    shared[1:] |= meets
    shared[:-1] |= meets
    count = np.bincount(of[shared], minlength=len(tag))
    some = np.flatnonzero(count)
    some = some[np.argsort(tag[some].view(U64), kind="stable")]
    yield _packed([(part, ex.pack_sorted(tag[some[a:e]].view(U64)), ex.pack_small(count[some[a:e]]), ex.pack_small(need[some[a:e]])) for part, a, e in ex.cuts(tag[some].view(U64), parts)], _COUNTS)


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tags of which as many keys are shared, over all parts, as they need."""
    tags, shared, needs = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for t, s, d in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("tags", "shared", "needs")], strict=True):
            tags.append(ex.unpack_sorted(t.as_py()))
            shared.append(ex.unpack_small(s.as_py()))
            needs.append(ex.unpack_small(d.as_py()))
    tag, at = np.unique(np.concatenate(tags), return_inverse=True)
    need = np.full(len(tag), np.iinfo(np.int64).max)
    np.minimum.at(need, at, np.concatenate(needs))
    enough = np.bincount(at, weights=np.concatenate(shared), minlength=len(tag)) >= need
    yield pa.RecordBatch.from_arrays([pa.array(tag[enough].view(np.int64), pa.int64())], names=["tag"])


def linkable(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of classes (class, n, sent, ..) that share enough with others to link at all."""
    total = classes.agg(F.sum("sent")).first()[0] or 0
    parts = max(2 * shuffle_partitions(docs.sparkSession), -(-8 * total // PART_BYTES))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shared_counts(batches, parts)

    sent = docs.select("text").mapInArrow(lambda b: _key_rows(b, parts), _KEYS)
    tags = sent.groupBy("part").applyInArrow(shared, _COUNTS).groupBy("part").applyInArrow(_enough, "tag long").distinct()
    tagged = classes.withColumn("tag", F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long"))
    need = F.ceil(F.lit(NUM) * F.col("n") / DEN) - (F.col("n") - F.col("sent"))
    found = tagged.join(tags, "tag", "left_semi")
    return found.unionByName(tagged.filter(need <= 0).join(tags, "tag", "left_anti")).drop("tag")


# --- second and third step: links among them --------------------------------


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, n, shingles) of the wanted (node, rep, class), rep now the node: sets as bytes, made from the texts again."""
    told = docs.select("doc_id", "text").join(small(wanted, 200_000), F.col("doc_id") == F.col("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _slices(batches, 1):
            kept = [(r, len(s), s.tobytes()) for r, c, s in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), sets, strict=True) if digest(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.binary())], names=["rep", "n", "shingles"])

    return told.select("node", "text", "class").mapInArrow(run, "rep long, n long, shingles binary")


def _tokens(sets: DataFrame, kind: str) -> DataFrame:
    """(token, rep, n) for every shingle of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                parts = [np.frombuffer(s, "<u8") for s in piece.column(2).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                tokens = np.concatenate([np.zeros(0, U64), *parts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), piece.column(0).take(of), piece.column(1).take(of)], names=["token", "rep", "n"])

    return sets.select("rep", "n", "shingles").mapInArrow(run, f"token long, rep {kind}, n long")


def _prefixes(sets: DataFrame, kind: str) -> DataFrame:
    """(token, rep, members): shared shingles in the prefix of each set, rarest first.

    A set's shingles that no other has come first of all and join with nothing,
    so they only shorten the rest of the prefix.
    """
    tokens = _tokens(sets, kind)
    having = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1"), "token")
    own = Window.partitionBy("rep")
    ranked = having.withColumn("rank", F.row_number().over(own.orderBy("members", "token"))).withColumn("shared", F.count("*").over(own))
    length = F.col("n") - F.ceil(NUM * F.col("n") / DEN) + 1
    return ranked.filter(F.col("rank") <= length - (F.col("n") - F.col("shared"))).select("token", "rep", "members")


def _by_group(table: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """Row numbers of each group of equal keys, of two rows or more."""
    columns = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    for rows in np.split(order, np.flatnonzero(new)):
        if len(rows) > 1:
            yield rows


def _pair_table(left: list, right: list, kind: pa.DataType) -> pa.Table:
    return pa.table({"a": pa.array(left, kind), "b": pa.array(right, kind)})


def _tree_links(table: pa.Table) -> pa.Table:
    reps, blobs, left, right = table.column("rep").to_pylist(), table.column("shingles").to_pylist(), [], []
    for rows in _by_group(table, "token", "salt"):
        ids = [reps[i] for i in rows]
        for i, j in group_links([np.frombuffer(blobs[r], "<u8") for r in rows]):
            left.append(ids[i])
            right.append(ids[j])
    return _pair_table(left, right, table.schema.field("rep").type)


def _tree_candidates(table: pa.Table) -> pa.Table:
    """(a, b, sure) across components, of two chunks only across them.

    Sets that are there whole are verified at once, and only links that connect
    something new come out; other pairs that signatures do not rule out come out unsure.
    """
    reps, comps, sizes, marks, chunk, whole = (table.column(c).to_pylist() for c in ("rep", "comp", "n", "mark", "chunk", "whole"))
    number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    forest, met = Forest(len(number)), set()
    for rows in _by_group(table, "token", "one", "two"):
        if len({forest.root(number[comps[r]]) for r in rows}) < 2:
            continue
        across = len({chunk[r] for r in rows}) > 1
        sets = [np.frombuffer(whole[r], "<u8") if whole[r] else None for r in rows]
        tree = SignatureTree(np.array([sizes[r] for r in rows]), [np.frombuffer(marks[r], "<u8") for r in rows])
        for left, right in tree.pairs():
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                x, y = rows[i], rows[j]
                one, two = number[comps[x]], number[comps[y]]
                if (across and chunk[x] == chunk[y]) or forest.root(one) == forest.root(two):
                    continue
                sure = sets[i] is not None and sets[j] is not None
                if sure and not linked(sets[i], sets[j]):
                    continue
                if sure:
                    forest.join(one, two)
                met.add((min(reps[x], reps[y]), max(reps[x], reps[y]), sure))
    kind = table.schema.field("rep").type
    return pa.table({"a": pa.array([p[0] for p in met], kind), "b": pa.array([p[1] for p in met], kind), "sure": pa.array([p[2] for p in met], pa.bool_())})


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(2).to_pylist()
        marks = [signature(np.frombuffer(s, "<u8")).tobytes() for s in blobs]
        whole = [s if len(s) <= 8 * WHOLE else None for s in blobs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(whole, pa.binary())], names=["rep", "n", "mark", "whole"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [linked(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _distinct_groups(prefixes: DataFrame) -> DataFrame:
    """Of shingles that the same sets have in their prefixes, one; their groups would meet the same pairs."""
    who = prefixes.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    one = who.filter("k > 1").groupBy("k", "x", "y").agg(F.min("token").alias("token"), F.max("k").alias("members")).select("token", "members")
    return prefixes.select("token", "rep").join(one, "token")


def _meet(shared: DataFrame, sets: DataFrame, kind: str, parts: int) -> DataFrame:
    """Links found in the `SENT` largest groups of each class; hot groups in chunks, dealt anew for each."""
    few = shared.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("members", "token")), asc=False), 1, SENT).alias("g")).select("rep", F.explode("g").alias("g"))
    salt = F.pmod(F.xxhash64("rep", "g.token"), F.ceil(F.col("g.members") / SALTED).cast("long"))
    sent = few.select("rep", F.col("g.token").alias("token"), salt.alias("salt")).join(sets.select("rep", "shingles"), "rep")
    return cut(sent.withColumn("part", F.pmod(F.xxhash64("token", "salt"), F.lit(parts))).groupBy("part").applyInArrow(_tree_links, f"a {kind}, b {kind}"))


def _open_rows(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(token, rep, members, comp) of the groups that still hold two components."""
    placed = shared.join(comps, F.col("rep") == F.col("node"), "left").select("token", "rep", "members", F.coalesce("component", "rep").alias("comp"))
    open_ = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return cut(placed.join(open_, "token"))


def links(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of the numbers of classes that connect all that is linked, and the stored tables behind them.

    wanted: (node, rep, class) of the classes that can link, as `numbered`.
    """
    spark = docs.sparkSession
    kind = "long"
    sets = cut(_sets_of(docs, wanted).dropDuplicates(["rep"]))
    size = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), -(-8 * SENT * size // PART_BYTES))
    shared = cut(_distinct_groups(_prefixes(sets, kind)))
    found = _meet(shared, sets, kind, parts)
    comps = cut(connected_components(found, "a", "b"))
    # Third step: groups that still hold two components, by signatures alone.
    rest = rest_ = _open_rows(shared, comps)
    chunks = F.ceil(F.col("members") / CHUNK).cast("long")
    rest = rest.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rest = rest.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other"))
    marks = sets.select("rep", "n", "shingles").mapInArrow(_with_marks, f"rep {kind}, n long, mark binary, whole binary")
    met = rest.select("token", "rep", "comp", "chunk", "one", "two").join(marks, "rep").withColumn("part", F.pmod(F.xxhash64("token", "one", "two"), F.lit(parts)))
    pairs = cut(met.groupBy("part").applyInArrow(_tree_candidates, f"a {kind}, b {kind}, sure boolean").distinct())
    one, two = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t"))
    second = pairs.filter("not sure").select("a", "b").join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(_verified, f"a {kind}, b {kind}")
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(pairs.filter("sure").select("a", "b")).union(second), [sets, shared, found, comps, rest_, pairs]


def numbered(wanted: DataFrame) -> DataFrame:
    """(node, rep, class): numbers in the order of (rep, class), so the least of a component is the class that names it."""
    return cut(wanted.select("rep", "class").orderBy("rep", "class").select(F.monotonically_increasing_id().alias("node"), "rep", "class"))


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, class, n, head, head_class) of every document: the doc_id and the class that name its component."""
    classed = cut(with_classes(docs))
    reps = classed.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sent").alias("sent"))
    wanted = numbered(linkable(docs, reps))
    linked_, used = links(docs, wanted)
    of = cut(connected_components(linked_, "a", "b"))
    discard(*used)
    heads = of.select("component").distinct().join(wanted, F.col("component") == F.col("node")).select("component", F.col("rep").alias("head"), F.col("class").alias("head_class"))
    led = of.join(wanted.select("node", "class"), "node").join(small(cut(heads)), "component").select("class", "head", "head_class")
    named = reps.join(led, "class", "left").select(F.col("class").alias("_class"), F.coalesce("head", "rep").alias("head"), F.coalesce("head_class", "class").alias("head_class"))
    lone = (F.col("n") == 0) | F.col("doc_id").isNull()
    own = classed.join(named, F.col("class") == F.col("_class"), "left")
    return own.select("doc_id", "mark", "class", "n", F.when(lone, F.col("doc_id")).otherwise(F.col("head")).alias("head"), F.when(lone, F.col("class")).otherwise(F.col("head_class")).alias("head_class"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _judged(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("head").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one whose id and class name it. Rows with a null id stay.

    Of rows that agree in id and class, one with the least hash of its text stays.
    """
    head = _judged(docs).filter("doc_id = head and class = head_class").groupBy("doc_id", "class", "mark").agg(F.count("*").alias("copies"))
    stay = cut(head.groupBy("doc_id", "class").agg(F.min(F.struct("mark", "copies")).alias("s")).select(F.col("doc_id").alias("__ns_stay"), F.col("s.mark").alias("__ns_mark"), F.col("s.copies").alias("__ns_copies")))
    same = (docs["doc_id"] == F.col("__ns_stay")) & (F.xxhash64(docs["text"]) == F.col("__ns_mark"))
    own = [docs[c] for c in docs.columns]
    kept = docs.join(small(stay.filter("__ns_copies = 1"), 500_000), same).select(*own)
    several = stay.filter("__ns_copies > 1")
    if not several.isEmpty():
        again = docs.join(small(several), same).dropDuplicates(["__ns_stay", "__ns_mark"]).select(*own)
        kept = kept.unionByName(again)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
