"""Periodic runs of words by power-of-two naming (operator 11).

A run is a stretch of a text with smallest period q (words q apart are the same), of
at least two periods and `least` words, that no neighbouring word extends. Texts are
taken whole, a slice of them at once as one sequence of words, an own separator after each:

1. words get exact numbers: their bytes, eight at a time, are numbered and the numbers
   paired again and again, so equal numbers mean equal words without any hash;
2. Karp-Miller-Rosenberg naming: the name of 2**k words is the rank of the pair of names
   of its halves. Levels end where no name repeats;
3. a run of period q has two neighbouring multiples of q in it with the same word, so
   for every q the grid of its multiples holds candidates for all runs. The longest
   common extension of a candidate to either side comes from the levels in descending
   order: where the names of 2**k words agree, it moves on by 2**k;
4. stretches found with several periods keep the smallest (the others are its multiples).

Texts in which no four words stand twice have no run and leave after the second level.
Candidates are listed a block at a time: n words cost n log n candidates, log n steps
each, and 4 log n bytes a word, whatever the text. A text is handled by one task.

Null and empty texts have no runs and collapse to the empty text; a null id is carried;
repeated rows give repeated results; empty tables give empty ones; input columns named
`runs` or `collapsed` give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words

LEAST = 12
#: Candidates that are listed and extended together.
BLOCK = 1 << 20
#: Bytes of kept words that are copied together.
COPY = 1 << 22
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
U64 = np.uint64


def steps(count: np.ndarray) -> np.ndarray:
    """0, 1, .. within each stretch of so many."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the different ones, and how many these are."""
    found, rank = np.unique(keys, return_inverse=True)
    return rank.reshape(-1), len(found)


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same for two words only if their bytes are the same.

    Numbers of eight bytes are paired in rounds; words of one length have as many rounds,
    so pairs of different rounds never meet.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    count = (size + 7) // 8
    at = np.repeat(start, count) + 8 * steps(count)
    left = np.minimum(np.repeat(end, count) - at, 8).astype(U64)
    piece, _ = ranked(eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left)))
    name, open_ = np.empty(len(start), np.int64), np.arange(len(start))
    while True:
        first = np.cumsum(count) - count
        single = count == 1
        name[open_[single]] = piece[first[single]]
        open_ = open_[~single]
        if not len(open_):
            break
        first, count = first[~single], count[~single]
        half = (count + 1) // 2
        a = np.repeat(first, half) + 2 * steps(half)
        paired = a + 1 < np.repeat(first + count, half)
        second = np.where(paired, piece[np.minimum(a + 1, len(piece) - 1)] + 1, 0)
        piece, count = ranked(piece[a] * (int(piece.max()) + 2) + second)[0], half
    return ranked(name * (int(size.max()) + 1) + size)[0]


class Levels:
    """Names of all stretches of 2**k words of a sequence in which every text ends with a separator of its own."""

    def __init__(self, first: np.ndarray) -> None:
        self.names = [first.astype(np.int32)]
        size, longest = 1, len(first)
        while 2 * size <= longest:
            low = self.names[-1]
            made, distinct = ranked(low[:-size].astype(np.int64) * (int(low.max()) + 1) + low[size:])
            if distinct == len(made):
                break
            # Stretches that pass the end hold the last separator: each has a name of its own.
            self.names.append(np.concatenate([made, distinct + np.arange(size)]).astype(np.int32))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same (i < j, in one text)."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            got += (self.names[k][i + got] == self.names[k][j + got]).astype(np.int64) << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a = i - got - (1 << k)
            same = self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(a, 0) + (j - i)]
            got += (same & (a >= 0)).astype(np.int64) << k
        return got


def _with_separators(names: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with a separator of its own after each, and where each text begins."""
    top = int(names.max(initial=-1)) + 1
    begin = np.cumsum(count + 1) - (count + 1)
    out = np.empty(len(names) + len(count), np.int64)
    out[begin + count] = top + np.arange(len(count))
    out[np.repeat(begin, count) + steps(count)] = names
    return out, begin


def _may_repeat(names: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Texts in which some four words stand twice."""
    whole, begin = _with_separators(names, count)
    two = ranked(whole[:-1] * (int(whole.max()) + 1) + whole[1:])[0] if len(whole) > 1 else whole[:0]
    if len(two) < 3:
        return np.zeros(len(count), bool)
    four, n = ranked(two[:-2] * (int(two.max()) + 1) + two[2:])
    text = np.repeat(np.arange(len(count)), count + 1)[: len(four)]
    key = np.sort(text * n + four)
    out = np.zeros(len(count), bool)
    out[key[1:][key[1:] == key[:-1]] // n] = True
    return out


def _smallest_period(found: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) in order, each stretch once, with its smallest period."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[new]


def find_runs(names: np.ndarray, count: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), in order of text, start and period; names: the words of all texts, count: how many each has."""
    none = np.zeros((0, 4), np.int64)
    kept = np.flatnonzero(_may_repeat(names, count) if least >= 8 else count > 1)
    if not len(kept):
        return none
    of = np.zeros(len(count), bool)
    of[kept] = True
    names, count = names[np.repeat(of, count)], count[kept]
    whole, begin = _with_separators(ranked(names)[0], count)
    levels = Levels(whole)
    text = np.repeat(np.arange(len(count)), count // 2)
    period = steps(count // 2) + 1
    tried = (count[text] - 1) // period
    upto, at, found = np.cumsum(tried), 0, []
    while at < len(tried):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + BLOCK, side="right")))
        number = tried[at:to]
        q = np.repeat(period[at:to], number)
        i = np.repeat(begin[text[at:to]], number) + steps(number) * q
        hit = whole[i] == whole[i + q]
        i, q, d = i[hit], q[hit], np.repeat(text[at:to], number)[hit]
        ahead = levels.forward(i, i + q)
        back = levels.backward(i, i + q)
        long = ahead + back >= np.maximum(q, least - q)
        i, q, d, ahead, back = i[long], q[long], d[long], ahead[long], back[long]
        found.append(_smallest_period(np.column_stack([kept[d], i - back - begin[d], ahead + back + q, q])))
        at = to
    found = _smallest_period(np.concatenate([none, *found]))
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _joined(words: _words.Words, stay: np.ndarray) -> pa.Array:
    """The words that stay of every row, joined by one space."""
    rows = len(words.first) - 1
    keep = np.flatnonzero(stay)
    size = words.end[keep] - words.start[keep] + 1  # a space after each
    row = words.row_of_word()[keep]
    total = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    upto = np.cumsum(size)
    out = np.empty(int(size.sum()), np.uint8)
    a = 0
    while a < len(keep):
        low = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, low + COPY, side="right")))
        at = np.repeat(words.start[keep[a:b]], size[a:b]) + steps(size[a:b])
        out[low : int(upto[b - 1])] = words.data[np.minimum(at, len(words.data) - 1)]
        a = b
    out[upto - 1] = 0x20
    out = np.delete(out, np.cumsum(total)[total > 0] - 1)  # none after the last word
    ends = np.cumsum(np.maximum(total - 1, 0))
    offsets = np.concatenate([[0], ends]).astype("<i8")
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def runs_of(texts: pa.Array, least: int = LEAST) -> tuple[pa.Array, pa.Array]:
    """Runs of every text (in order of start and period), and the texts without what repeats a run's first period."""
    words = _words.split(texts)
    count = np.diff(words.first)
    found = find_runs(word_names(words.data, words.start, words.end), count, least)
    text, start, length, period = found.T
    low = words.first[text] + start
    edge = np.bincount(low + period, minlength=len(words.start) + 1) - np.bincount(low + length, minlength=len(words.start) + 1)
    collapsed = _joined(words, np.cumsum(edge)[: len(words.start)] == 0)
    offsets = np.searchsorted(text, np.arange(len(count) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(_RUN_TYPE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with `runs` (start, length, period; word numbers from 0) and `collapsed` (the kept words joined by one space).

    A word is dropped if some run holds it after that run's first period.
    """
    keep = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = docs.select(*keep).withColumns({"runs": F.lit(None).cast(RUNS), "collapsed": F.lit(None).cast("string")}).schema
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _words.slices(batch, "text"):
                runs, collapsed = runs_of(piece.column(at), least)
                yield pa.RecordBatch.from_arrays([*piece.columns, runs, collapsed.cast(pa.string())], names=[*keep, "runs", "collapsed"])

    return docs.select(*keep).mapInArrow(run, schema)
