"""Exact token counts by prefix dynamic programming (operator 6).

A byte-pair encoding is the one sequence of pieces in which every neighbouring
pair is what the merges make of that pair alone. So the last piece of each
prefix follows from the last pieces of shorter ones, and one pass over a text
gives the token count of every prefix. `prefix_table` stores these counts beside
each text; totals, truncation and budget questions read the stored counts and
encode nothing again.

Texts are cut between characters that no piece of the vocabulary has side by side
(merges cannot reach across), so a corpus is made of short parts, and the table of
each different part is worked out once: all different parts of a slice of texts
advance together, character by character, in numpy arrays. A worker keeps the
tables of parts and the verdicts on pairs, each within `KEPT_BYTES`; beyond that
it starts afresh.

Parts compare by 64-bit hashes of their characters (a chance of one in 10^7 that
two of a million different parts merge). Null and empty texts have no tokens;
repeated rows are counted alike; an empty table gives an empty result; a text of
any length is taken whole, at some 50 bytes a character; extra columns are carried
along, and a column that has the result's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words

MARK = "▁"
#: Bytes of tables, and of pairs, that a worker keeps.
KEPT_BYTES = 48 << 20
U64 = np.uint64


class PrefixCounter:
    """Token counts of all prefixes under a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if model.normalize("ﬁ  Å①") != MARK + "ﬁ  Å①".replace(" ", MARK):
            raise ValueError("the model changes texts before it cuts them")
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.longest = max(map(len, self.score), default=1)
        long = [p for p in self.score if len(p) > 1]
        # Characters that stand in longer pieces are numbered; which may stand side by side?
        self.chars = {c: i + 1 for i, c in enumerate(sorted({c for p in long for c in p}))}
        self.number = np.zeros(0x110000, np.int32)
        for c, i in self.chars.items():
            self.number[ord(c)] = i
        wide = len(self.chars) + 1
        self.beside = np.zeros((wide, wide), bool)
        for p in long:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[self.chars[a], self.chars[b]] = True
        # Pieces by number: the vocabulary, and single characters beyond it, which cost their bytes.
        self.pieces = [*self.score, *[c for c in self.chars if c not in self.score]]
        self.cost = np.array([1 if p in self.score else len(p.encode()) for p in self.pieces], np.int32)
        self.stands = np.array([len(p) == 1 or self.merged(p) == [p] for p in self.pieces])
        codes = np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])])
        hashes = _hashes(codes, at[:-1], at[1:])
        order = np.argsort(hashes)
        self.piece_hash, self.piece_of = hashes[order], order
        if (self.piece_hash[1:] == self.piece_hash[:-1]).any():
            raise ValueError("two pieces have one hash")
        self._forget_parts()
        self._forget_pairs()

    def _forget_parts(self) -> None:
        self.part_hash, self.part_at, self.part_counts = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget_pairs(self) -> None:
        self.pair, self.pair_meets = np.zeros(0, np.int64), np.zeros(0, bool)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by merging the best pair, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def meets(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave these pieces as they are when they stand side by side."""
        wanted = left * len(self.pieces) + right
        at = np.searchsorted(self.pair, wanted)
        known = self.pair[np.minimum(at, len(self.pair) - 1)] == wanted if len(self.pair) else np.zeros(len(wanted), bool)
        if not known.all():
            if self.pair.nbytes > KEPT_BYTES:
                self._forget_pairs()
                known[:] = False
            new = np.unique(wanted[~known])
            strings = [(self.pieces[a], self.pieces[b]) for a, b in zip(*(x.tolist() for x in divmod(new, len(self.pieces))), strict=True)]
            ok = np.array([self.merged(a + b) == [a, b] for a, b in strings], bool)
            pair = np.concatenate([self.pair, new])
            order = np.argsort(pair, kind="stable")
            self.pair, self.pair_meets = pair[order], np.concatenate([self.pair_meets, ok])[order]
            at = np.searchsorted(self.pair, wanted)
        return self.pair_meets[at]

    def _tables(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of the prefixes of 0, 1, .. characters of these parts, one after the other."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        own = np.cumsum(size + 1) - (size + 1)
        counts, last = np.zeros(int((size + 1).sum()), np.int32), np.full(int((size + 1).sum()), -1, np.int64)
        for s in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -s, side="left"))  # parts of more than s characters
            words, ends, pieces = [], [], []
            for length in range(1, self.longest + 1):
                n = int(np.searchsorted(-size[:live], -(s + length), side="right"))
                if not n:
                    break
                a = start[:n] + s
                hashed = _hashes(codes, a, a + length)
                at = np.minimum(np.searchsorted(self.piece_hash, hashed), len(self.piece_hash) - 1)
                piece = self.piece_of[at]
                w = np.flatnonzero((self.piece_hash[at] == hashed) & self.stands[piece])
                words.append(w)
                ends.append(np.full(len(w), s + length))
                pieces.append(piece[w])
            w, end, piece = np.concatenate(words), np.concatenate(ends), np.concatenate(pieces)
            if s:
                ok = self.meets(last[own[w] + s], piece)
                w, end, piece = w[ok], end[ok], piece[ok]
            last[own[w] + end] = piece
            counts[own[w] + end] = counts[own[w] + s] + self.cost[piece]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        size, own = size[back], own[back]
        return counts[np.repeat(own, size + 1) + _steps(size + 1)]

    def _known(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where in `part_counts` the table of each part begins; new parts are worked out."""
        hashed = _hashes(codes, start, end)
        unique, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.searchsorted(self.part_hash, unique)
        known = self.part_hash[np.minimum(at, len(self.part_hash) - 1)] == unique if len(self.part_hash) else np.zeros(len(unique), bool)
        if not known.all():
            if self.part_counts.nbytes + self.part_hash.nbytes + self.part_at.nbytes > KEPT_BYTES:
                self._forget_parts()
                known[:] = False
            new = np.flatnonzero(~known)
            low, size = start[first[new]], (end - start)[first[new]]
            counts = np.zeros(int((size + 1).sum()), np.int32)
            own = np.cumsum(size + 1) - (size + 1)
            alone = self.number[codes[low]] == 0  # a character in no longer piece
            single = np.flatnonzero(alone)
            counts[own[single] + 1] = [1 if chr(c) in self.score else len(chr(c).encode()) for c in codes[low[single]].tolist()]
            rest = np.flatnonzero(~alone)
            counts[np.repeat(own[rest], size[rest] + 1) + _steps(size[rest] + 1)] = self._tables(codes, low[rest], size[rest])
            hash_, place = np.concatenate([self.part_hash, unique[new]]), np.concatenate([self.part_at, own + len(self.part_counts)])
            order = np.argsort(hash_, kind="stable")
            self.part_hash, self.part_at, self.part_counts = hash_[order], place[order], np.concatenate([self.part_counts, counts])
            at = np.searchsorted(self.part_hash, unique)
        return self.part_at[at][back]

    def prefixes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of text[:i] for every i of every text, one after the other, and where each text's counts begin (one more than texts)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        codes = np.frombuffer("".join([MARK + t for t in texts]).encode("utf-32-le"), np.uint32).copy()
        codes[codes == 32] = ord(MARK)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        number = self.number[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.beside[number[:-1], number[1:]]
        begins[at[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(codes))
        table, size = self._known(codes, start, end), end - start
        total = self.part_counts[table + size]
        upto = np.cumsum(total) - total
        first = np.searchsorted(start, at[:-1])
        base = upto - np.repeat(upto[first], np.diff(np.append(first, len(start))))
        counts = np.repeat(base, size).astype(np.int32) + self.part_counts[np.repeat(table, size) + _steps(size) + 1]
        counts[at[:-1]] = 0  # the empty prefix has not even the leading mark
        return counts, at


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, .. within each stretch of so many."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


#: Odd multipliers, one for each place in a part; places beyond take them again, with the round mixed in.
_PLACES = _words.mix(np.arange(1, 65, dtype=U64)) | U64(1)


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of characters."""
    size = end - start
    out = size.astype(U64)
    if not len(size):
        return out
    with np.errstate(over="ignore"):
        if int(size.max()) <= len(_PLACES):
            live = np.arange(len(size))
            for i in range(int(size.max())):
                live = live[size[live] > i]
                out[live] += (codes[start[live] + i].astype(U64) + U64(1)) * _PLACES[i]
        else:
            step = _steps(size)
            each = (codes[np.repeat(start, size) + step].astype(U64) + U64(1)) * _PLACES[step % len(_PLACES)]
            late = step >= len(_PLACES)
            each[late] *= _words.mix(step[late].astype(U64)) | U64(1)
            out += np.add.reduceat(each, np.cumsum(size) - size)
    return _words.mix(out)


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def prefix_table(docs: DataFrame, model_file: str, text: str = "text", out: str = "token_prefix") -> DataFrame:
    """docs with `out`: at place i of the array the tokens of the first i characters, of every whole text; model_file must lie on every machine."""
    kept = [c for c in docs.columns if c != out]
    docs = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(model_file).prefixes
        for batch in batches:
            for piece in _words.slices(batch, text):
                counts, begin = prefixes([t or "" for t in piece.column(at).to_pylist()])
                column = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, column], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def total(prefix: str | Column = "token_prefix") -> Column:
    """Tokens of the whole text, from the stored counts."""
    return F.element_at(prefix, -1).cast("long")


def fitting(prefix: str | Column, budget: int | Column) -> Column:
    """Characters of the longest prefix of at most so many tokens, from the stored counts."""
    col = F.col(prefix) if isinstance(prefix, str) else prefix
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.size(col) - F.array_position(F.reverse(F.transform(col, lambda n: n <= limit)), True).cast("int")


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the exact token count of every whole text."""
    kept = [c for c in docs.columns if c != out]
    made = prefix_table(docs.select(*[docs[c] for c in kept]), model_file, text, "__ns_prefix")
    return made.select(*kept, total("__ns_prefix").alias(out))


def truncate(docs: DataFrame, budget: int | Column, text: str = "text", prefix: str = "token_prefix") -> DataFrame:
    """A prefix table with every text cut to its longest prefix of at most budget tokens, and the counts with it."""
    n = fitting(prefix, budget)
    cut = {text: F.substr(F.col(text), F.lit(1), n), prefix: F.slice(prefix, F.lit(1), n + 1)}
    return docs.select(*[cut[c].alias(c) if c in cut else docs[c] for c in docs.columns])


def token_digest(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; totals are read from the stored prefix counts by Spark."""
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kept = ["doc_id", "n_bytes"]
    schema = rows.select(*kept).schema.add("token_prefix", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(model_file).prefixes
        for batch in batches:
            for piece in _words.slices(batch, "text"):
                counts, begin = prefixes([t or "" for t in piece.column(1).to_pylist()])
                column = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), column], names=[*kept, "token_prefix"])

    return rows.mapInArrow(run, schema).select(*kept, total().alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
