"""Quality classifier by attention-based multiple-instance learning (operator 8).

A document is a bag of passages of `PASSAGE` consecutive words. A passage is
encoded as the mean of the embeddings of its words' features (shape, last byte,
the word itself, whether it repeats in the passage); gated attention
softmax(w . (tanh(V h) * sigmoid(U h))) over the document's passages weighs the
encodings, and a linear layer scores the weighted one. Embeddings, attention and
classifier are trained jointly in numpy with Adam from document labels, on at
most `SAMPLE` labelled documents.

The broadcast model has a fixed size and scoring is per row, without a shuffle.
Null and empty texts are one empty passage; repeated rows score alike; with no
labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._labels import held_out, training_rows

PASSAGE, BUCKETS, DIM, GATE = 64, 1 << 13, 12, 8
SAMPLE, EPOCHS, BATCH, RATE, DECAY = 4000, 12, 128, 0.01, 1e-4
FEATURES = 4
U64 = np.uint64

_CLASS = np.zeros(256, np.int64)  # kinds of bytes: 1 upper, 2 lower or beyond ASCII, 3 digit, 4 symbol, 5 other sign
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[list(b"!?.,;:'\"()[]{}/\\-_=+@^~`")] = 5


@dataclass
class Bags:
    """Features of the words of some texts, their passages and their rows."""

    bucket: np.ndarray  # words x FEATURES
    passage: np.ndarray  # of each word
    row: np.ndarray  # of each passage


def bags(column: pa.Array) -> Bags:
    words = _words.split(column, _words.SPACED)
    n, rows = len(words.hash), len(words.first) - 1
    kind = _CLASS[words.data]
    counts = []
    for k in (1, 3, 4, 5):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts.append(total[words.end] - total[words.start])
    upper, digit, symbol, sign = counts
    size = words.end - words.start
    few = lambda x: np.minimum(x, 3)
    shape = (np.where(upper == 0, 0, np.where(upper == size - symbol - sign, 2, 1)) * 4 + few(symbol)) * 16 + few(sign) * 4 + few(digit)
    shape = shape * 6 + np.searchsorted([3, 6, 10, 15, 25], size, side="right")
    row_of = words.row_of_word()
    place = np.arange(n) - words.first[row_of]
    each = np.diff(words.first)
    many = np.maximum(-(-each // PASSAGE), 1)
    base = np.cumsum(many) - many
    passage = base[row_of] + place // PASSAGE
    # Whether the word came before in its passage, and whether just before.
    key = _words.mix(words.hash ^ (passage.astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(n, np.int64)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, np.int64)
    twice[1:] = (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])
    last = words.data[words.end - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    parts = [shape, last, (words.hash % U64(1 << 40)).astype(np.int64), again + twice]
    bucket = np.stack([(_words.mix(p.astype(U64) * U64(FEATURES) + U64(i)) % U64(BUCKETS)).astype(np.int64) for i, p in enumerate(parts)], 1) if n else np.zeros((0, FEATURES), np.int64)
    return Bags(bucket, passage, np.repeat(np.arange(rows), many))


def _segment_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights=values[:, d], minlength=n) for d in range(values.shape[1])], 1)


@dataclass
class Model:
    """Parameters: table, V, U, w, c, b."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, b: Bags, rows: int) -> dict[str, np.ndarray]:
        p, n = self.p, len(b.row)
        size = np.maximum(np.bincount(b.passage, minlength=n), 1) * FEATURES
        word = p["table"][b.bucket].sum(1)
        h = _segment_sum(word, b.passage, n) / size[:, None]
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -50, 50)))
        e = (t * g) @ p["w"]
        top = np.full(rows, -np.inf)
        np.maximum.at(top, b.row, e)
        a = np.exp(e - top[b.row])
        a /= np.bincount(b.row, weights=a, minlength=rows)[b.row]
        z = _segment_sum(h * a[:, None], b.row, rows)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -500, 500)))
        return {"size": size, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.p:
            return np.full(len(column), 0.5)
        return self.forward(bags(column), len(column))["s"]

    def attention(self, text: str) -> np.ndarray:
        """The weights of a text's passages."""
        return self.forward(bags(pa.array([text])), 1)["a"]

    def gradients(self, b: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        p, rows = self.p, len(y)
        f = self.forward(b, rows)
        d = (f["s"] - y) / rows
        dz = d[:, None] * p["c"]
        da = (f["h"] * dz[b.row]).sum(1)
        de = f["a"] * (da - np.bincount(b.row, weights=f["a"] * da, minlength=rows)[b.row])
        dt, dg = de[:, None] * f["g"] * p["w"] * (1 - f["t"] ** 2), de[:, None] * f["t"] * p["w"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[b.row] + dt @ p["V"].T + dg @ p["U"].T
        word = (dh / f["size"][:, None])[b.passage]
        table = _segment_sum(np.repeat(word, FEATURES, 0), b.bucket.ravel(), BUCKETS) if len(word) else np.zeros_like(p["table"])
        return {"table": table, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ((f["t"] * f["g"]) * de[:, None]).sum(0), "c": f["z"].T @ d, "b": np.array([d.sum()])}


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """Joint training; the same rows give the same model."""
    if not texts:
        return Model()
    rng, y = np.random.default_rng(seed), np.array(labels, float)
    base = (y.sum() + 1) / (len(y) + 2)
    model = Model({"table": rng.normal(size=(BUCKETS, DIM)) * 0.1, "V": rng.normal(size=(DIM, GATE)) * 0.5, "U": rng.normal(size=(DIM, GATE)) * 0.5, "w": rng.normal(size=GATE) * 0.5, "c": rng.normal(size=DIM), "b": np.array([np.log(base / (1 - base))])})
    order = rng.permutation(len(texts))
    batch = min(BATCH, max(16, len(order) // 32))
    batches = [(bags(pa.array([texts[i] for i in order[at : at + batch]], pa.string())), y[order[at : at + batch]]) for at in range(0, len(order), batch)]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in model.gradients(*batches[i]).items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[k] -= rate * m / (np.sqrt(v) + 1e-8) + RATE * DECAY * model.p[k] * (k == "table")
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score of every document, under a model fitted on its labelled ones."""
    model = train(*training_rows(docs, labels, "quality", sample))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _words.slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(handle.value.scores(piece.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
