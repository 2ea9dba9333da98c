"""Substring dedup by compacted de Bruijn paths (operator 10).

Every 13 consecutive words are an edge of the de Bruijn graph of the corpus, from
the node of its first 12 words to that of its last 12. A node belongs to a bucket
by its minimizer (the least hash of the 5-word runs inside), and neighbouring
nodes of a text mostly to the same one:

1. minimizers are exchanged in packed rows; those of one document only are
   dropped, which rules out nearly all unrepeated text;
2. runs of nodes with a repeated minimizer are exchanged with the edges that touch
   them. A bucket thus has all edges into and out of its nodes: it finds the
   earliest occurrence of each edge (its source), and where one repeated edge only
   ever follows one other, and their sources follow each other too, the two
   compact. So come pieces of nonbranching paths, with places and source places;
3. a piece that ends with an edge into another bucket's node is joined to the
   piece there that begins with this edge. Spark joins glue the pieces of a text
   two runs at a time, then two such blocks, until no end is open;
4. source coordinates verify the paths: the words at the source are digested (128
   bits), and a path goes only if its own words have the same digest.

An edge's identity is a 64-bit hash; where two merge, a path can fail its
verification, and its words stay (a chance of about one in 10^4 anywhere in a
corpus of 10^8 repeated edges).

The earlier document is the one with the smaller doc_id; null ids are later than
all others and never a source; rows of one doc_id (and all of null ids) take
nothing from each other. Paths belong to a row's text: they are keyed by doc_id
and a 64-bit hash of the text, null ids included, so texts that share an id lose
their own words only. Texts of fewer than 13 words keep all, texts of any length
are taken whole; empty tables give empty results; extra columns are carried by
`dedup_substrings`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, shuffle_partitions, small
from . import _exchange as ex
from . import _words

EDGE, SEED = 13, 5
#: Bytes of text that one task's share of the keys comes from, at most.
PART_BYTES = 16 << 20
LATEST = np.iinfo(np.int64).max
U64 = np.uint64


def nodes(words: _words.Words, k: int = EDGE, m: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge hashes (by first word), and first word and minimizer of every node of the rows that have an edge."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    seed = _words.grams(words.hash, m)
    width, have, least = k - m, 1, seed
    while have < width:  # minimum over a doubling stretch
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    size = np.diff(words.first)
    left = np.repeat(words.first[1:], size) - np.arange(n)  # words left in the row
    at = np.flatnonzero((left[: len(least)] >= k - 1) & (np.repeat(size, size)[: len(least)] >= k))
    return _words.grams(words.hash, k), at, least[at]


def runs(words: _words.Words, at: np.ndarray, minimizer: np.ndarray, k: int = EDGE) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring nodes with one minimizer: row, number in the row, minimizer, first edge, edges that touch it, and whether the first and the last of these touch another run too."""
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, minimizer, none, none, none.astype(bool), none.astype(bool)
    row = words.row_of_word()[at]
    new = np.ones(len(at), bool)
    new[1:] = (minimizer[1:] != minimizer[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    low, high, of = at[head], at[np.append(head[1:], len(at)) - 1], row[head]
    open_left, open_right = low > words.first[of], high + k <= words.first[of + 1]
    first, last = low - open_left, high - ~open_right
    number = np.arange(len(head)) - np.searchsorted(of, of)
    return of, number, minimizer[head], first, last - first + 1, open_left, open_right


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LATEST).to_numpy(zero_copy_only=False)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with what tells rows apart: `__ns_id` (null ids are LATEST) and `__ns_mark` (hash of the text)."""
    return docs.withColumn("__ns_id", F.coalesce(docs["doc_id"].cast("long"), F.lit(LATEST))).withColumn("__ns_mark", F.xxhash64("text"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.get_field_index(n)) for n in names], strict=True):
            yield tuple(x.as_py() for x in row)


# --- first step: repeated minimizers ------------------------------------------

_SEEDS = "part int, ids binary, marks binary, keys binary, entry binary"


def _seed_rows(batches: Iterator[pa.RecordBatch], parts: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _words.slices(batch, "text"):
            words = _words.split(piece.column(1))
            _, at, minimizer = nodes(words, k)
            row, _, keys, *_ = runs(words, at, minimizer, k)
            ids, marks = _ids(piece.column(0)), _ids(piece.column(2))
            order = np.lexsort((row, keys))
            keys, row = keys[order], row[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            keys, row = keys[once], row[once]
            out = []
            for part, a, e in ex.cuts(keys, parts):
                rows, entry = np.unique(row[a:e], return_inverse=True)
                out.append((part, ids[rows].astype("<i8").tobytes(), marks[rows].astype("<i8").tobytes(), ex.pack_sorted(keys[a:e]), ex.pack_small(entry)))
            yield _batch(out, _SEEDS)


def _repeated_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, key) for keys that two documents have; the texts of one document count once."""
    keys, ids, marks = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for docs, texts, packed, entry in _rows(batches, "ids", "marks", "keys", "entry"):
        at = ex.unpack_small(entry)
        keys.append(ex.unpack_sorted(packed))
        ids.append(np.frombuffer(docs, "<i8")[at])
        marks.append(np.frombuffer(texts, "<i8")[at])
    keys, ids, marks = np.concatenate(keys), np.concatenate(ids), np.concatenate(marks)
    order = np.lexsort((ids, keys))
    keys, ids, marks = keys[order], ids[order], marks[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(keys)))
    shared = np.repeat(ids[head] != ids[head + size - 1], size)
    yield pa.RecordBatch.from_arrays([pa.array(ids[shared], pa.int64()), pa.array(marks[shared], pa.int64()), pa.array(keys[shared].view(np.int64), pa.int64())], names=["doc_id", "mark", "key"])


# --- second step: pieces of paths ---------------------------------------------

_RUNS = "part int, ids binary, marks binary, keys binary, number binary, start binary, edges binary, open binary, hashes binary"
_PIECES = "doc_id long, mark long, block long, start long, n_edges long, source_id long, source_mark long, source_start long, open_left boolean, open_right boolean"


def _run_rows(batches: Iterator[pa.RecordBatch], parts: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of (__ns_id, __ns_mark, text, __ns_keys) to packed runs whose minimizer is among their own document's repeated ones."""
    for batch in batches:
        for piece in _words.slices(batch, "text"):
            words = _words.split(piece.column(2))
            own, at, minimizer = nodes(words, k)
            row, number, keys, first, count, left, right = runs(words, at, minimizer, k)
            shared = piece.column(3)
            flat = shared.flatten().to_numpy(zero_copy_only=False).view(U64)
            of = np.repeat(np.arange(piece.num_rows), shared.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            in_row = lambda key, r: _words.mix(key ^ (r.astype(U64) * U64(_words.BYTE_BASE)))
            keep = np.flatnonzero(np.isin(in_row(keys, row), in_row(flat, of)))
            keep = keep[np.argsort(keys[keep], kind="stable")]
            row, number, keys, first, count, open_ = row[keep], number[keep], keys[keep], first[keep], count[keep], (left + 2 * right)[keep]
            ids, marks, start = _ids(piece.column(0))[row], _ids(piece.column(1))[row], first - words.first[row]
            out = []
            for part, a, e in ex.cuts(keys, parts):
                each = np.repeat(first[a:e], count[a:e]) + _steps(count[a:e])
                out.append((part, ids[a:e].astype("<i8").tobytes(), marks[a:e].astype("<i8").tobytes(), ex.pack_sorted(keys[a:e]), ex.pack_small(number[a:e]), ex.pack_small(start[a:e]), ex.pack_small(count[a:e]), ex.pack_small(open_[a:e]), own[each].astype("<u8").tobytes()))
            yield _batch(out, _RUNS)


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, .. within each stretch of so many."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of repeated edges through the nodes of a bucket, in all documents but the sources."""
    got = [(np.frombuffer(d, "<i8"), np.frombuffer(t, "<i8"), ex.unpack_small(b), ex.unpack_small(s), ex.unpack_small(n), ex.unpack_small(o), np.frombuffer(h, "<u8")) for d, t, b, s, n, o, h in _rows(batches, "ids", "marks", "number", "start", "edges", "open", "hashes")]
    ids, marks, number, start, count, open_, own = (np.concatenate([g[i] for g in got]) for i in range(7))
    del got
    # Runs in the order of document, text and number; a repeated row brings every run again, and one stays.
    order = np.lexsort((number, marks, ids))
    a, b = order[1:], order[:-1]
    other_doc = ids[a] != ids[b]
    other_text = other_doc | (marks[a] != marks[b])
    single = np.append(True, other_text | (number[a] != number[b]))[: len(order)]
    doc_of, text_of = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    doc_of[order], text_of[order] = np.append(0, np.cumsum(other_doc))[: len(order)], np.append(0, np.cumsum(other_text))[: len(order)]
    keep = np.zeros(len(order), bool)
    keep[order[single]] = True
    own = own[np.repeat(keep, count)]
    ids, marks, number, start, count, open_, doc_of, text_of = (x[keep] for x in (ids, marks, number, start, count, open_, doc_of, text_of))
    run = np.repeat(np.arange(len(ids), dtype=np.int32), count)
    place = (start[run] + _steps(count)).astype(np.int32)
    # The occurrences of an edge, the earliest first: this is its source.
    order = np.lexsort((place, text_of[run], own)).astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    del own
    head = np.flatnonzero(new)
    edge, source, doc = np.empty(len(order), np.int32), np.empty(len(order), np.int32), doc_of[run]
    edge[order] = np.cumsum(new, dtype=np.int32) - 1
    source[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    repeated = doc[order[head]] != doc[order[np.append(head[1:], len(order)) - 1]] if len(head) else new
    del order, new
    later = doc[source] < doc
    # Which repeated edges stand next to each other, at a node of this bucket.
    near = np.flatnonzero((run[1:] == run[:-1]) & repeated[edge[1:]] & repeated[edge[:-1]])
    pairs = np.unique(edge[near].astype(np.int64) << 32 | edge[near + 1])
    out, into = np.bincount(pairs >> 32, minlength=len(head)), np.bincount(pairs & 0xFFFFFFFF, minlength=len(head))
    # A later edge goes on from the edge before if nothing else does, here or there, and their sources follow each other too.
    near = near[later[near] & later[near + 1]]
    near = near[(out[edge[near]] == 1) & (into[edge[near + 1]] == 1)]
    s, t = source[near], source[near + 1]
    near = near[(text_of[run[s]] == text_of[run[t]]) & (place[t] == place[s] + 1)]
    goes_on = np.zeros(len(run), bool)
    goes_on[near + 1] = True
    at, rest = np.flatnonzero(later & ~goes_on), np.flatnonzero(later)
    n = np.diff(np.append(np.searchsorted(rest, at), len(rest)))
    first = np.cumsum(count) - count
    for low in range(0, len(at), 1 << 16):
        x, size = at[low : low + (1 << 16)], n[low : low + (1 << 16)]
        r, src = run[x], source[x]
        left = (x == first[r]) & (open_[r] & 1 > 0)
        right = (x + size == first[r] + count[r]) & (open_[r] & 2 > 0)
        longs = (ids[r], marks[r], number[r], place[x], size, ids[run[src]], marks[run[src]], place[src])
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in longs], pa.array(left), pa.array(right)], names=[f.split()[0] for f in _PIECES.split(", ")])


# --- third step: pieces are glued ----------------------------------------------


def _glued(pieces: DataFrame) -> DataFrame:
    """Whole paths: in each round the open ends between blocks 2i and 2i + 1 of a text join, and the two blocks become one."""
    active, done, used = pieces, [], [pieces]
    sides = "open_right and block % 2 = 0", "open_left and block % 2 = 1"
    for _ in range(64):
        done.append(active.filter("not open_left and not open_right"))
        open_ = active.filter("open_left or open_right")
        if open_.isEmpty():
            break
        left, right = open_.filter(sides[0]), open_.filter(sides[1]).selectExpr("doc_id", "mark", "block - 1 as block", "start as r_start", "n_edges as r_edges", "open_right as r_open")
        met = left.join(right, ["doc_id", "mark", "block"]).filter("r_start = start + n_edges - 1")
        met = met.withColumn("n_edges", F.col("n_edges") + F.col("r_edges") - 1).withColumn("open_right", F.col("r_open")).select(*pieces.columns)
        rest = open_.filter(f"not ({sides[0]}) and not ({sides[1]})")
        active = cut(rest.union(met).withColumn("block", F.shiftright("block", 1)))
        used.append(active)
    else:
        raise RuntimeError("paths did not settle")
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    whole = cut(whole.select("doc_id", "mark", "start", "n_edges", "source_id", "source_mark", "source_start"))
    discard(*used)
    return whole


def repeated_paths(docs: DataFrame, k: int = EDGE) -> DataFrame:
    """Compacted paths: doc_id, mark, start, n_edges, source_id, source_mark, source_start (word numbers; mark: xxhash64 of the text).

    docs: doc_id (integer) and text, and whatever else; a null id shows as the
    largest long.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))
    keyed = _keyed(docs.select("doc_id", "text"))
    seeds = keyed.select("__ns_id", "text", "__ns_mark").mapInArrow(lambda b: _seed_rows(b, parts, k), _SEEDS)
    shared = seeds.groupBy("part").applyInArrow(_repeated_seeds, "doc_id long, mark long, key long").groupBy(F.col("doc_id").alias("__ns_id"), F.col("mark").alias("__ns_mark")).agg(F.collect_list("key").alias("__ns_keys"))
    told = keyed.select("__ns_id", "__ns_mark", "text").join(shared, ["__ns_id", "__ns_mark"])
    sent = told.mapInArrow(lambda b: _run_rows(b, parts, k), _RUNS)
    return _glued(cut(sent.groupBy("part").applyInArrow(_pieces, _PIECES)))


# --- fourth step: verification and removal -------------------------------------


def span_digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


def _source_digests(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(source_id, source_mark, source_start, n_edges, digest) of the words at the sources."""
    asked = paths.select("source_id", "source_mark", "source_start", "n_edges").distinct()
    by_text = cut(asked.groupBy(F.col("source_id").alias("__ns_id"), F.col("source_mark").alias("__ns_mark")).agg(F.collect_list(F.struct("source_start", "n_edges")).alias("__ns_spans")))
    told = _keyed(docs.select("doc_id", "text")).join(_beside(by_text), ["__ns_id", "__ns_mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, mark, text, spans in _rows([batch], "__ns_id", "__ns_mark", "text", "__ns_spans"):
                words = text.encode().split()
                out += [(id_, mark, s["source_start"], s["n_edges"], span_digest(words, s["source_start"], s["n_edges"] + k - 1)) for s in spans]
            yield _batch(out, _DIGESTS)

    return told.select("__ns_id", "__ns_mark", "text", "__ns_spans").mapInArrow(run, _DIGESTS).dropDuplicates(["source_id", "source_mark", "source_start", "n_edges"])


_DIGESTS = "source_id long, source_mark long, source_start long, n_edges long, digest binary"


def _beside(by_text: DataFrame) -> DataFrame:
    """Spans by text, broadcast where there are few of them."""
    of = by_text.columns[-1]
    spans = by_text.agg(F.sum(F.size(of))).first()[0] or 0
    return small(by_text, 200_000) if spans <= 400_000 else by_text


def _with_paths(docs: DataFrame, k: int) -> DataFrame:
    """docs with `__ns_paths`: array of (start, n, digest) that go, if the words have the digest."""
    paths = repeated_paths(docs, k)
    digests = cut(_source_digests(docs, paths, k))  # a table of its own, so that a join can split a source that a third of all paths name
    sure = paths.join(small(digests, 200_000), ["source_id", "source_mark", "source_start", "n_edges"])
    found = cut(sure.groupBy(F.col("doc_id").alias("__ns_id"), F.col("mark").alias("__ns_mark")).agg(F.collect_list(F.struct(F.col("start"), (F.col("n_edges") + k - 1).alias("n"), "digest")).alias("__ns_paths")))
    return _keyed(docs).join(_beside(found), ["__ns_id", "__ns_mark"], "left").drop("__ns_id", "__ns_mark")


def _kept(text: str | None, paths: list | None) -> tuple[list[bytes], int, int]:
    """Kept words, words, removed words; a path whose words differ from its source's is left alone."""
    words = (text or "").encode().split()
    if not paths:
        return words, len(words), 0
    gone = np.zeros(len(words) + 1, np.int64)
    for p in paths:
        a, e = p["start"], p["start"] + p["n"]
        if e <= len(words) and span_digest(words, a, p["n"]) == p["digest"]:
            gone[a] += 1
            gone[e] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    kept = [w for w, s in zip(words, stay, strict=True) if s]
    return kept, len(words), len(words) - len(kept)


def report(docs: DataFrame, k: int = EDGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t.as_py(), p.as_py()) for t, p in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(r[0])).hexdigest() for r in rows], pa.string())], names=schema.names)

    return _with_paths(docs.select("doc_id", "text"), k).select("doc_id", "text", "__ns_paths").mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, k: int = EDGE) -> DataFrame:
    """docs without the repeated words; texts that lose nothing stay as they are."""
    at = docs.columns.index("text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, p in zip(batch.column(at), batch.column(len(names)), strict=True):
                text = t.as_py()
                kept, _, gone = _kept(text, p.as_py()) if p.is_valid else ([], 0, 0)
                texts.append(b" ".join(kept).decode() if gone else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return _with_paths(docs, k).select(*names, "__ns_paths").mapInArrow(run, docs.schema)
