"""Line dedup by a sharded minimal perfect hash (operator 12).

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at
least `chars` code points that at least `documents` documents hold lose all their lines
but those of the largest doc_id that holds them.

1. tasks split their documents into lines and store, a chunk of documents at a time, the
   different keys of the chunk (64 bits that place a key, 32 more that tell it apart) and
   which line of which document has which key;
2. the keys go to shards by ranges of their hash. A shard is a minimal perfect hash over
   its different hashes: levels of bits, where a key belongs to the first level in which
   it is alone at its bit, and its index is the number of bits set before. The index leads
   into arrays of fingerprints, counts of documents and largest ids;
3. every chunk probes the shards with its keys; keys whose count reaches the limit come
   back with their largest id, and the chunk says which lines of which rows go. Lines of
   documents are never joined with lines; texts meet only their own rows' line numbers.

A chunk names a key once and with its `documents` largest ids, which is all that the
count (held at the limit) and the largest id depend on: a line that a third of all
documents hold costs a few ids a chunk. Two different keys with the same 64 bits are told
apart by the fingerprint, and those beside the first stand in a list of their own.
Merged are only keys that agree in all 96 bits.

A document is a doc_id: rows that share one count once, and each loses its own lines. A
row without an id is no document: it counts for nothing and loses every line whose key
reaches the limit. Null and empty texts are one empty line. Lines and texts of any length
are hashed whole, a stretch at a time; empty tables give empty results; extra columns are
carried, those named `n_lines` or `n_dropped` give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, shuffle_partitions
from . import _exchange as ex
from . import _words

CHARS, DOCUMENTS = 20, 3
#: Bytes of text that one shard's keys come from, about.
SHARD_BYTES = 16 << 20
#: Lines of a chunk, about: a slice of documents adds to it until it has so many.
CHUNK_LINES = 1 << 17
#: Bits of a level for each key that comes to it.
GAMMA = 2
#: A-Z count as a-z in a key; white space inside it counts.
FOLDED = _words._table([], fold=True)
U64 = np.uint64


# --- lines and their hashes -----------------------------------------------------


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes, folded by the table; spans in order, of any length."""
    up, down = _words.powers(base, _words.STRETCH + 1)
    step, back = U64(pow(base, _words.STRETCH, 1 << 64)), U64(pow(base, -_words.STRETCH, 1 << 64))
    value = _words._BYTE_VALUES[np.maximum(table, 0)]
    stretch = _words.STRETCH
    at_start, at_end = np.zeros(len(start), U64), np.zeros(len(end), U64)
    inverse = np.zeros(len(start), U64)
    before, scale, undo = U64(0), U64(1), U64(1)
    with np.errstate(over="ignore"):
        for low in range(0, len(data) + 1, stretch):
            part = data[low : low + stretch]
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(value[part] * up[: len(part)], out=total[1:])
            total = total * scale + before
            for of, out in ((start, at_start), (end, at_end)):
                a, e = np.searchsorted(of, [low, low + stretch])
                out[a:e] = total[of[a:e] - low]
            a, e = np.searchsorted(start, [low, low + stretch])
            inverse[a:e] = down[start[a:e] - low] * undo
            before, scale, undo = total[-1], scale * step, undo * back
        return _words.mix((at_end - at_start) * inverse + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def line_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, first line of each row, key start, key end): every line of every row, its key without the white space around it."""
    data, at = _words.buffers(column)
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([at[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, at[1:]]))
    first = np.searchsorted(breaks, at) + np.arange(len(at))
    inside = np.flatnonzero((_words.SPACED >= 0)[data])
    low, high = np.searchsorted(inside, start), np.searchsorted(inside, end)
    some = high > low
    inside = np.append(inside, 0)
    return data, at, first, np.where(some, inside[np.minimum(low, len(inside) - 1)], start), np.where(some, inside[np.maximum(high, 1) - 1] + 1, start)


def _long_lines(piece: pa.RecordBatch, chars: int) -> tuple[np.ndarray, ...]:
    """(h1, h2, row, line number in the row) of the lines whose key has enough code points; columns: doc_id, mark, text."""
    data, _, first, start, end = line_spans(piece.column(2))
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    long = np.flatnonzero(points[end] - points[start] >= chars)
    row = np.searchsorted(first, long, side="right") - 1
    start, end = start[long], end[long]
    h1 = span_hashes(data, start, end, FOLDED, _words.BYTE_BASE)
    h2 = (span_hashes(data, start, end, FOLDED, _words.WORD_BASE) >> U64(32)).astype("<u4")
    return h1, h2, row, long - first[row]


# --- first step: chunks -----------------------------------------------------------

_CHUNKS = "chunk long, ids binary, known binary, marks binary, keys binary, prints binary, key_of binary, row_of binary, number_of binary"
_KEYS = "shard int, keys binary, prints binary, ids binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _chunk_rows(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, mark, text) to chunks; a chunk's number is its task's and its own in the task."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    gathered, lines = [], 0
    for batch in batches:
        for piece in _words.slices(batch, "text"):
            h1, h2, row, line = _long_lines(piece, chars)
            rows, row = np.unique(row, return_inverse=True)
            ids = piece.column(0).take(pa.array(rows))
            gathered.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), piece.column(1).take(pa.array(rows)).to_numpy(zero_copy_only=False), h1, h2, row, line))
            lines += len(h1)
            if lines >= CHUNK_LINES:
                yield _chunk(number, gathered)
                number, gathered, lines = number + 1, [], 0
    if lines:
        yield _chunk(number, gathered)


def _chunk(number: int, gathered: list[tuple]) -> pa.RecordBatch:
    ids, known, marks, h1, h2, _, line = (np.concatenate([g[i] for g in gathered]) for i in range(7))
    before = np.cumsum([0, *[len(g[0]) for g in gathered]])
    row = np.concatenate([g[5] + b for g, b in zip(gathered, before[:-1], strict=True)])
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    return _batch([(number, ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), marks.astype("<i8").tobytes(), ex.pack_sorted(h1[new]), h2[new].tobytes(), ex.pack_small(key), ex.pack_small(row), ex.pack_small(line))], _CHUNKS)


def _rows(batch: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch[n][i].as_py() for n in names)


# --- second step: shards ----------------------------------------------------------


def largest_ids(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its largest different ids, `most` at most: in order of key, the largest id first."""
    order = np.lexsort((~ids, h2, h1))
    h1, h2, ids = h1[order], h2[order], ids[order]
    key = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)]
    new = key | np.append(True, ids[1:] != ids[:-1])[: len(h1)]
    h1, h2, ids, key = h1[new], h2[new], ids[new], key[new]
    head = np.flatnonzero(key)
    place = np.arange(len(h1)) - np.repeat(head, np.diff(np.append(head, len(h1))))
    stay = place < most
    return h1[stay], h2[stay], ids[stay]


def _shard_rows(batches: Iterator[pa.RecordBatch], shards: int, most: int) -> Iterator[pa.RecordBatch]:
    """Chunks to packed rows of (key, id), a row for each shard that a chunk has keys of."""
    for batch in batches:
        for ids, known, keys, prints, key_of, row_of in _rows(batch, "ids", "known", "keys", "prints", "key_of", "row_of"):
            ids, known, h1, h2 = np.frombuffer(ids, "<i8"), np.frombuffer(known, "u1") > 0, ex.unpack_sorted(keys), np.frombuffer(prints, "<u4")
            key, row = ex.unpack_small(key_of), ex.unpack_small(row_of)
            key, row = key[known[row]], row[known[row]]
            h1, h2, ids = largest_ids(h1[key], h2[key], ids[row], most)
            yield _batch([(s, ex.pack_sorted(h1[a:e]), h2[a:e].tobytes(), ids[a:e].astype("<i8").tobytes()) for s, a, e in ex.cuts(h1, shards)], _KEYS)


@dataclass
class PerfectHash:
    """A minimal perfect hash: different keys get the indexes 0 .. n - 1.

    Level after level, every key left is thrown at GAMMA bits a key; a key alone at its
    bit stays there, the others go on. The index is the number of bits set before.
    """

    levels: list[np.ndarray]  #: bits of each level

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = _words.mix(keys ^ _words.mix(np.full(1, level + 1, U64) * U64(_words.WORD_BASE)))
        return ((h >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(64, GAMMA * len(keys))
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; a key that was not built in gets any index, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, before = np.arange(len(keys)), 0
        for number, bits in enumerate(self.levels):
            place = self._place(keys[left], number, len(bits))
            rank = np.cumsum(bits, dtype=np.int32)
            here = bits[place]
            out[left[here]] = before + rank[place[here]] - 1
            left, before = left[~here], before + int(rank[-1])
            if not len(left):
                break
        return out

    def pack(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpack(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool) for b in levels])


_INDEX = "shard int, levels array<binary>, prints binary, counts binary, largest binary, other_keys binary, other_prints binary, other_counts binary, other_largest binary"


def _index_shard(table: pa.Table, most: int) -> pa.Table:
    """The index of a shard from its (key, id) rows."""
    got = [(ex.unpack_sorted(k), np.frombuffer(p, "<u4"), np.frombuffer(i, "<i8")) for k, p, i in _rows(table, "keys", "prints", "ids")]
    h1, h2, ids = largest_ids(*(np.concatenate([g[i] for g in got]) for i in range(3)), most)
    head = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    count = np.diff(np.append(head, len(h1)))
    h1, h2, largest = h1[head], h2[head], ids[head]
    first = np.append(True, h1[1:] != h1[:-1])  # of the keys with one 64-bit hash
    hashed = PerfectHash.build(h1[first])
    order = np.argsort(hashed.index(h1[first]))
    row = [table["shard"][0].as_py(), hashed.pack()]
    for some in (first, ~first):
        p, c, m = h2[some], count[some], largest[some]
        at = order if some is first else np.arange(len(p))
        row += [*([] if some is first else [h1[some].tobytes()]), p[at].tobytes(), ex.pack_small(c[at]), m[at].astype("<i8").tobytes()]
    kinds = [pa.int32(), pa.list_(pa.binary()), *[pa.binary()] * 7]
    names = [f.split()[0] for f in _INDEX.split(", ")]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)


def _probe_rows(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, keys, prints in _rows(batch, "chunk", "keys", "prints"):
            h1, h2 = ex.unpack_sorted(keys), np.frombuffer(prints, "<u4")
            yield _batch([(s, chunk, a, ex.pack_sorted(h1[a:e]), h2[a:e].tobytes()) for s, a, e in ex.cuts(h1, shards)], _PROBES)


_PROBES = "shard int, chunk long, first long, keys binary, prints binary"
_ANSWERS = "chunk long, key_of binary, largest binary"


def look_up(index: dict, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, largest id) of each key; a key that the index does not hold has count 0."""
    count, largest = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    at = index["hash"].index(h1)
    here = np.flatnonzero(at >= 0)
    here = here[index["prints"][at[here]] == h2[here]]
    count[here], largest[here] = index["counts"][at[here]], index["largest"][at[here]]
    keys, prints = index["other_keys"], index["other_prints"]
    for i in np.flatnonzero(np.isin(h1, keys)) if len(keys) else ():
        for j in np.flatnonzero((keys == h1[i]) & (prints == h2[i])):
            count[i], largest[i] = index["other_counts"][j], index["other_largest"][j]
    return count, largest


def read_index(table: pa.Table) -> dict:
    """The arrays of one shard's row."""
    get = lambda n: table[n][0].as_py()
    out = {"hash": PerfectHash.unpack(get("levels")), "other_keys": np.frombuffer(get("other_keys"), U64)}
    for side in ("", "other_"):
        out |= {f"{side}prints": np.frombuffer(get(f"{side}prints"), "<u4"), f"{side}counts": ex.unpack_small(get(f"{side}counts")), f"{side}largest": np.frombuffer(get(f"{side}largest"), "<i8")}
    return out


def _probe_shard(probes: pa.Table, index: pa.Table, most: int) -> pa.Table:
    """Which keys of each chunk reach the limit, with their largest ids; a shard without an index holds keys of rows without ids only."""
    out = []
    if index.num_rows:
        arrays = read_index(index)
        for chunk, first, keys, prints in _rows(probes, "chunk", "first", "keys", "prints"):
            count, largest = look_up(arrays, ex.unpack_sorted(keys), np.frombuffer(prints, "<u4"))
            hit = np.flatnonzero(count >= most)
            if len(hit):
                out.append((chunk, ex.pack_small(hit + first), largest[hit].astype("<i8").tobytes()))
    return pa.Table.from_batches([_batch(out, _ANSWERS)])


# --- third step: the lines that go --------------------------------------------------

_GONE = "doc_id long, mark long, number int"


def _gone_lines(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """(doc_id, mark, number) of the lines of a chunk that go, each once."""
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "number": pa.array([], pa.int32())})
    if not answers.num_rows or not chunk.num_rows:
        return empty
    ids, known, marks, keys, key_of, row_of, number_of = next(_rows(chunk, "ids", "known", "marks", "keys", "key_of", "row_of", "number_of"))
    ids, known, marks = np.frombuffer(ids, "<i8"), np.frombuffer(known, "u1") > 0, np.frombuffer(marks, "<i8")
    common, largest = np.zeros(int(np.frombuffer(keys, "<u8", 1)[0]), bool), np.zeros(int(np.frombuffer(keys, "<u8", 1)[0]), np.int64)
    for at, most in _rows(answers, "key_of", "largest"):
        at = ex.unpack_small(at)
        common[at], largest[at] = True, np.frombuffer(most, "<i8")
    key, row, number = ex.unpack_small(key_of), ex.unpack_small(row_of), ex.unpack_small(number_of)
    goes = np.flatnonzero(common[key] & (~known[row] | (ids[row] != largest[key])))
    row, number = row[goes], number[goes]
    return pa.table({"doc_id": pa.array(ids[row], pa.int64(), mask=~known[row]), "mark": pa.array(marks[row], pa.int64()), "number": pa.array(number, pa.int32())})


def line_index(chunks: DataFrame, shards: int, most: int = DOCUMENTS) -> DataFrame:
    """A row for each shard: its minimal perfect hash and the arrays that it leads into."""
    return chunks.mapInArrow(lambda b: _shard_rows(b, shards, most), _KEYS).groupBy("shard").applyInArrow(lambda t: _index_shard(t, most), _INDEX)


def common_lines(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, mark, gone): the numbers of the lines that go, in order, for every row that loses some; mark is xxhash64 of the text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4 * shuffle_partitions(spark), -(-size // SHARD_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    chunks = cut(keyed.mapInArrow(lambda b: _chunk_rows(b, chars), _CHUNKS))
    index = cut(line_index(chunks, shards, documents))
    probes = chunks.mapInArrow(lambda b: _probe_rows(b, shards), _PROBES)
    answers = cut(probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(lambda p, i: _probe_shard(p, i, documents), _ANSWERS))
    gone = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_gone_lines, _GONE)
    made = cut(gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("number")).alias("gone")))
    discard(chunks, index, answers)
    return made


def without_lines(text: str, gone: list[int]) -> str:
    lines = text.split("\n")
    stay = np.ones(len(lines), bool)
    stay[gone] = False
    return "\n".join([lines[i] for i in np.flatnonzero(stay)])


def dedup_lines(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """docs without the lines that go, with `n_lines` (before) and `n_dropped`; texts that lose nothing stay as they are."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = docs.select(*keep).withColumns({"n_lines": F.lit(None).cast("long"), "n_dropped": F.lit(None).cast("long")}).schema
    gone = common_lines(docs, chars, documents).select(F.col("doc_id").alias("__ns_id"), F.col("mark").alias("__ns_mark"), F.col("gone").alias("__ns_gone"))
    told = docs.select(*keep, F.xxhash64("text").alias("__ns_own")).join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__ns_id")) & (F.col("__ns_own") == F.col("__ns_mark")), "left")
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(at), batch.column(len(keep))
            data, rows = _words.buffers(texts)
            n_lines = np.diff(np.searchsorted(np.flatnonzero(data == 0x0A), rows)) + 1
            if lost.null_count < len(lost):
                texts = pa.array([without_lines(t.as_py(), g.as_py()) if g.is_valid else t.as_py() for t, g in zip(texts, lost, strict=True)], pa.string())
            dropped = lost.value_lengths().fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*[texts if i == at else batch.column(i) for i in range(len(keep))], pa.array(n_lines, pa.int64()), dropped], names=schema.names)

    return told.select(*keep, "__ns_gone").mapInArrow(run, schema)
