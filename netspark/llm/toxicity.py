"""Toxicity by subword-bag embeddings (operator 1).

A word is the bag of its character n-grams (3 to 5, with marks at its ends) and
itself, each a hashed row of an embedding table; a text is the mean of the rows
of all its words; a linear softmax reads it. Table (plain momentum steps with
shrinkage) and softmax (Adam) are trained jointly in numpy, on at most `SAMPLE`
labelled documents. A misspelt word shares most n-grams, and so most of its
vector, with the word.

An n-gram has a vector only if it is in `RARE` training documents at least and its
share of toxic ones is further than `APART` standard deviations from the base
rate; in a small sample all others would be noise. The mean is over the n-grams of
a text that have a vector, and `CALM` more at zero, so that one chance n-gram
weighs little in a text without others.

Two classes read the mean through one difference of weights, so scoring needs a
number a bucket: the model that is broadcast has `2 * BUCKETS` numbers, whatever
the corpus. Scoring is per row, without a shuffle.

Null and empty texts get the score of the bias; repeated rows score alike; with
no labelled rows every score is 0.5; an empty table gives an empty result; texts of
any length are scored whole, at some 100 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._labels import held_out, training_rows

#: Bounds of the model and of what it is fitted on.
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 4, 3, 5
SAMPLE, EPOCHS, BATCH = 4000, 16, 256
#: Plain gradient steps of the table, with a pull of each n-gram's vector to zero (so
#: that what few documents have stays zero); Adam's step of the softmax; and in how
#: many training documents, and how far from the base rate, an n-gram must be to have
#: a vector at all.
TABLE_RATE, MOMENTUM, PULL, RATE, RARE, APART, CALM = 60.0, 0.9, 0.004, 0.03, 3, 3.5, 40.0
U64 = np.uint64


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word, and where each word's begin (one more than words)."""
    text = (" " + " ".join(w.decode(errors="replace") for w in words) + " ").lower()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)
    gaps = np.flatnonzero(codes == 32)  # word i lies between gaps i and i + 1, which serve as its marks
    hashed = _words.mix(codes + U64(0x51ED270B))
    up, down = _words.powers(_words.WORD_BASE, len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(hashed * up[: len(codes)], out=total[1:])
        left, right = gaps[:-1], gaps[1:] + 1
        length = right - left
        made, owner = [], []

        def add(at: np.ndarray, to: np.ndarray, of: np.ndarray) -> None:
            made.append(_words.mix((total[to] - total[at]) * down[at] + (to - at).astype(U64)))
            owner.append(of)

        add(left, right, np.arange(len(left)))
        for n in range(SHORTEST, LONGEST + 1):
            many = np.maximum(length - n + 1, 0) - (length == n)  # the whole word is there already
            of = np.repeat(np.arange(len(left)), np.maximum(many, 0))
            at = left[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            add(at, at + n, of)
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    bucket = (np.concatenate(made)[order] % U64(buckets)).astype(np.int64)
    return bucket, np.searchsorted(owner_all[order], np.arange(len(words) + 1))


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number) of each word of some texts, and the subwords of the distinct words."""
    words = _words.split(column, _words.SPACED_LOWER)
    _, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    bucket, at = subwords([raw[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])
    return words.row_of_word(), number, bucket, at


@dataclass
class Model:
    """What scoring needs: a number a bucket, whether it has a vector, and a bias."""

    weight: np.ndarray
    live: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        row, number, bucket, at = bags(column)
        each = len(at) > 1
        sums = np.add.reduceat(self.weight[bucket], at[:-1]) if each else np.zeros(0)
        n = np.add.reduceat(self.live[bucket], at[:-1], dtype=np.int64) if each else np.zeros(0)
        total = np.bincount(row, weights=sums[number], minlength=len(column))
        count = np.bincount(row, weights=n[number], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / (count + CALM), -500, 500)))


def _spread(starts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Indices of the subwords of each of these words, one word after the other."""
    n = np.diff(starts)[number]
    return np.repeat(starts[:-1][number], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """Joint training of the embeddings and the softmax over them."""
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool), 0.0)
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    soft = rng.normal(size=(DIM, 2)).astype(np.float32)
    documents, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    bias = np.log(np.maximum(np.bincount(y, minlength=2), 1) / len(y)).astype(np.float32)
    order = rng.permutation(len(texts))
    rough, batch = [], min(BATCH, max(32, len(order) // 16))
    for at in range(0, len(order), batch):
        mine = order[at : at + batch]
        row, number, bucket, starts = bags(pa.array([texts[i] for i in mine], pa.string()))
        n = np.diff(starts)
        # Each (row, distinct word) once, with how often it stands there.
        pair, times = np.unique(row * max(len(n), 1) + number, return_counts=True)
        r, w = (pair // max(len(n), 1)).astype(np.int32), (pair % max(len(n), 1)).astype(np.int32)
        for i in range(len(mine)):  # by document, so that no list of all subwords of all words is needed
            own = np.unique(bucket[_spread(starts, w[r == i])])
            documents[own] += 1
            toxic[own] += y[mine[i]]
        rough.append((y[mine], r, w, times, bucket.astype(np.int32), starts))
    rate = y.mean()
    spread = np.sqrt(np.maximum(documents * rate * (1 - rate), 1e-9))
    seen = (documents >= RARE) & (np.abs(toxic - documents * rate) >= APART * spread)
    batches = []
    while rough:
        gold, r, w, times, bucket, starts = rough.pop()
        # Words keep only n-grams that have a vector; words without any are left out.
        live = seen[bucket]
        left = np.add.reduceat(live, starts[:-1], dtype=np.int64) if len(starts) > 1 else np.zeros(0, np.int64)
        bucket, new = bucket[live], np.cumsum(left > 0) - 1
        keep = left[w] > 0
        size = np.bincount(r, weights=times * left[w], minlength=len(gold)) + CALM
        r, w, share, left = r[keep], new[w[keep]].astype(np.int32), (times / size[r])[keep].astype(np.float32), left[left > 0]
        starts = np.cumsum(left) - left
        used, slot = np.unique(bucket, return_inverse=True)
        slot = slot.astype(np.int32)
        by_slot = np.argsort(slot, kind="stable")
        owner = np.repeat(np.arange(len(left), dtype=np.int32), left)[by_slot]
        back = np.argsort(w, kind="stable").astype(np.int32)
        batches.append((gold, r, w, share, back, np.flatnonzero(np.diff(w[back], prepend=-1)), used, slot, starts, owner, np.searchsorted(slot[by_slot], np.arange(len(used)))))
    pace = np.zeros((BUCKETS, DIM), np.float32)
    table = (rng.normal(size=(BUCKETS, DIM)) * 0.01 * seen[:, None]).astype(np.float32)
    moments = [(np.zeros_like(soft), np.zeros_like(soft)), (np.zeros_like(bias), np.zeros_like(bias))]
    step = 0
    for epoch in range(EPOCHS):
        fade = 1 - epoch / EPOCHS
        rate = RATE * fade
        for b in rng.permutation(len(batches)):
            gold, r, w, share, back, heads, used, slot, starts, owner, at = batches[b]
            step += 1
            rows = np.arange(len(gold))
            if len(used):
                word = np.add.reduceat(table[used][slot], starts)
                mean = np.stack([np.bincount(r, weights=share * word[w, d], minlength=len(gold)) for d in range(DIM)], 1).astype(np.float32)
            else:
                mean = np.zeros((len(gold), DIM), np.float32)
            scale = float(LEVEL)
            logit = scale * mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[rows, gold] -= 1
            p /= len(gold)
            grads = [scale * mean.T @ p, p.sum(0)]
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            if len(used):
                d_mean = scale * p @ soft.T
                d_word = np.add.reduceat((share[:, None] * d_mean[r])[back], heads)
                g = np.add.reduceat(d_word[owner], at)
                pace[used] = MOMENTUM * pace[used] + g
                moved = table[used] - fade * TABLE_RATE * pace[used]
                length = np.sqrt((moved * moved).sum(1, keepdims=True))
                table[used] = moved * np.maximum(0, 1 - fade * PULL / np.maximum(length, 1e-12))
            for x, g, (m, v) in zip((soft, bias), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * fix * m / (np.sqrt(v) + 1e-8)
    weight = LEVEL * table @ (soft[:, 1] - soft[:, 0])
    return Model(weight.astype(np.float64), seen, float(bias[1] - bias[0]))


#: The mean of many embeddings is short; the softmax reads so many times it.
LEVEL = 10.0


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score of every document, under a model fitted on its labelled ones."""
    model = train(*training_rows(docs, labels, "toxic", sample))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _words.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(handle.value.scores(piece.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
