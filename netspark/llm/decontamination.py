"""Benchmark decontamination by suffix arrays (operator 4).

Training text is dealt into shards (a few MB of whole documents, as Spark hands
them out). In each shard's task a suffix array over its words is built in numpy
and every benchmark suffix is looked up by binary search; all occurrences of a
window come out as a range of the array, and occurrences that follow each other
in both texts join to maximal verbatim matches with their places. Documents
never leave their partition, so nothing is shuffled.

The benchmark reaches the tasks in blocks of about `BLOCK_BYTES` of text (or one
longer text), dealt by item and text and each broadcast by itself; the driver holds
one block at a time, and a larger benchmark means more passes over a partition's
rows, not larger broadcasts.

Words compare by 64-bit hashes; texts of any length are one shard each. Null and empty texts have no words; benchmark
rows without id are not items; rows of one item_id are one item; repeated
documents are judged alike; with an empty benchmark nothing is hit; extra
columns are carried by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words

WINDOW = 10
BLOCK_BYTES = 32 << 20


class SuffixArray:
    """The suffixes of a shard's documents in the order of their first `depth` words at least (all, if fewer are left)."""

    def __init__(self, words: _words.Words, depth: int = WINDOW):
        n_rows = len(words.first) - 1
        self.row_of = words.row_of_word()
        self.vocab, ids = np.unique(words.hash, return_inverse=True)
        n = len(ids)
        # Word i of row r stands at i + r; the zeros between rows end every comparison.
        self.seq = np.zeros(n + n_rows + 4 * depth, np.int64)
        self.place = np.arange(n) + self.row_of
        self.seq[self.place] = ids + 1
        part, m = self.seq, len(self.seq)
        step = 1
        while step < depth:  # ranks of three words, then of twelve by four ranks of three, and so on
            fields = 3 if step == 1 else 4
            at = [np.concatenate([part[k * step :], np.zeros(k * step, np.int64)]) for k in range(fields)]
            part = _ranks(at)
            part[self.seq == 0] = 0
            step *= fields
        order = np.argsort(part[self.place], kind="stable")
        self.at = self.place[order]
        self.word = order  # index of the word at which each suffix begins
        self.size = m

    def ranges(self, queries: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word ids (1-based in vocab) the range of suffixes that begin with its first `length` words."""
        return self._bound(queries, length, False), self._bound(queries, length, True)

    def _bound(self, queries: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.at), np.int64)
        width = np.arange(queries.shape[1])
        used = width < length[:, None]
        while (open_ := low < high).any():
            mid = (low + high) // 2
            have = self.seq[np.minimum(self.at[np.minimum(mid, len(self.at) - 1)][:, None] + width, self.size - 1)]
            differs = (have != queries) & used
            first = differs.argmax(1)
            row = np.arange(len(queries))
            less = differs[row, first] & (have[row, first] < queries[row, first])
            equal = ~differs[row, first]
            right = (less | (equal & after)) & open_
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low


def _ranks(fields: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of the rows of these columns, in their order."""
    bits = max(1, int(max(int(f.max(initial=0)) for f in fields)).bit_length())
    rank = fields[0]
    taken = bits
    for f in fields[1:]:
        if taken + bits > 62:
            rank = np.unique(rank, return_inverse=True)[1]
            taken = max(1, int(rank.max(initial=0)).bit_length())
        rank, taken = (rank << bits) | f, taken + bits
    return np.unique(rank, return_inverse=True)[1]


@dataclass
class Items:
    """A block of the benchmark: its items' words and their windows."""

    ids: list
    hash: np.ndarray  # words of all texts
    window_at: np.ndarray  # index into hash of each window's first word
    window_len: np.ndarray
    window_item: np.ndarray  # index into ids


def windows_of(rows: list[tuple], window: int = WINDOW) -> Items:
    """Windows of (item_id, text) rows: `window` consecutive words, or all words of a shorter text."""
    ids = sorted({r[0] for r in rows}, key=str)
    number = {x: i for i, x in enumerate(ids)}
    words = _words.split(pa.array([r[1] for r in rows], pa.string()), _words.ALNUM_LOWER)
    at, length, item = [], [], []
    for i, r in enumerate(rows):
        a, e = int(words.first[i]), int(words.first[i + 1])
        if e > a:
            k = min(window, e - a)
            starts = np.arange(a, e - k + 1)
            at.append(starts)
            length.append(np.full(len(starts), k))
            item.append(np.full(len(starts), number[r[0]]))
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return Items(ids, words.hash, join(at), join(length), join(item))


def hits(words: _words.Words, items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows in a shard: (index of the first word, index of the window)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words.hash) or not len(items.window_at):
        return none
    array = SuffixArray(words, window)
    at = np.searchsorted(array.vocab, items.hash)
    ids = np.where(array.vocab[np.minimum(at, len(array.vocab) - 1)] == items.hash, at + 1, -1)
    padded = np.concatenate([ids, np.full(window, -1)])
    query = padded[items.window_at[:, None] + np.arange(window)]
    # A window with a word that the shard lacks cannot occur in it.
    whole = np.flatnonzero(((query > 0) | (np.arange(window) >= items.window_len[:, None])).all(1))
    if not len(whole):
        return none
    low, high = array.ranges(query[whole], items.window_len[whole])
    n = high - low
    which = np.repeat(whole, n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return array.word[np.repeat(low, n) + step], which


def maximal(words: _words.Words, items: Items, word: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Maximal verbatim matches (row, first word in row, words, index of item, first word in the block) from occurrences."""
    row = words.row_of_word()[word]
    diagonal = items.window_at[which] - word
    order = np.lexsort((word, diagonal, items.window_item[which], row))
    out: list[list[int]] = []
    for i in order:
        w, k, length = int(word[i]), int(which[i]), int(items.window_len[which[i]])
        key = (int(row[i]), int(items.window_item[k]), int(diagonal[i]))
        if out and tuple(out[-1][:3]) == key and w <= out[-1][3] + out[-1][4]:
            out[-1][4] = max(out[-1][4], w + length - out[-1][3])
        else:
            out.append([*key, w, length])
    return [(r, w - int(words.first[r]), n, item, w + d) for r, item, d, w, n in out]


def _blocks(bench: DataFrame, block_bytes: int) -> list:
    """Broadcast handles of the benchmark in blocks of bounded size."""
    bench = bench.select("item_id", "text").filter("item_id is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    spark = bench.sparkSession
    out = []
    for b in range(n):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect()
        out.append(spark.sparkContext.broadcast([tuple(r) for r in rows]))
    return out


_ready: list = [None, 0, None]


def _items(handle, window: int) -> Items:
    """The block's windows, made once by a worker as long as it works on the same block."""
    rows = handle.value
    if _ready[0] is not rows or _ready[1] != window:
        _ready[:] = [rows, window, windows_of(rows, window)]
    return _ready[2]


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, _words.Words]]:
    for batch in batches:
        for shard in _words.slices(batch, text):
            yield shard, _words.split(shard.column(shard.schema.get_field_index(text)), _words.ALNUM_LOWER)


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every maximal verbatim match: doc_id, item_id, first word in the document, words."""
    schema = T.StructType([docs.schema["doc_id"], bench.schema["item_id"], T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
    found = None
    for handle in _blocks(bench, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            items = _items(handle, window)
            for shard, words in _shards(batches, "text"):
                each = maximal(words, items, *hits(words, items, window))
                ids = shard.column(0).to_pylist()
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[r], "item_id": items.ids[i], "doc_word": w, "n_words": n} for r, w, n, i, _ in each], schema=to_arrow(schema))

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    for handle in _blocks(bench, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            items = _items(handle, window)
            for shard, words in _shards(batches, "text"):
                word, _ = hits(words, items, window)
                clean = np.ones(shard.num_rows, bool)
                clean[words.row_of_word()[word]] = False
                yield shard.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated.

    Blocks are passed one after the other; each adds its spans and items to the
    row, and the last columns come from these by expressions.
    """
    spans, names = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    state = docs.select("doc_id", "text", F.array().cast(spans).alias("_spans"), F.array().cast(names).alias("_items"), F.lit(0).cast("long").alias("n_words"))
    schema = state.schema
    handles = _blocks(bench, block_bytes)
    for number, handle in enumerate(handles):
        last = number == len(handles) - 1

        def run(batches: Iterator[pa.RecordBatch], handle=handle, last=last) -> Iterator[pa.RecordBatch]:
            items = _items(handle, window)
            for shard, words in _shards(batches, "text"):
                word, which = hits(words, items, window)
                row = words.row_of_word()[word]
                spans, names = shard.column(2).to_pylist(), shard.column(3).to_pylist()
                covered = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(covered, word, 1)
                np.add.at(covered, word + items.window_len[which], -1)
                inside = np.cumsum(covered) > 0
                for r in np.unique(row):
                    step = np.diff(np.concatenate([[0], inside[words.first[r] : words.first[r + 1]].view(np.int8), [0]]))
                    spans[r] += np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel().tolist()
                for r, i in np.unique(np.stack([row, items.window_item[which]]), axis=1).T:
                    names[r].append(str(items.ids[i]))
                text = pa.nulls(shard.num_rows, shard.schema.field(1).type) if last else shard.column(1)
                yield pa.RecordBatch.from_arrays([shard.column(0), text, pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(np.diff(words.first), pa.int64())], names=shard.schema.names)

        state = state.mapInArrow(run, schema)
    if len(handles) > 1:
        merged = F.expr("""aggregate(sort_array(transform(sequence(0, CAST(size(_spans) / 2 AS INT) - 1), i -> struct(_spans[2 * i] AS a, _spans[2 * i + 1] AS e))),
            struct(0L AS n, -1L AS upto), (s, x) -> struct(s.n + greatest(0L, x.e - greatest(x.a, s.upto)) AS n, greatest(s.upto, x.e) AS upto), s -> s.n)""")
        n_hit = F.when(F.size("_spans") > 0, merged).otherwise(0)
    else:
        n_hit = F.expr("aggregate(transform(_spans, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    items = F.array_sort(F.array_distinct("_items"))  # an item's texts can lie in several blocks
    return state.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))
