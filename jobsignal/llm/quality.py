"""Operator 5: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded
by surface measures of its words and bytes and a learned layer; gated attention
(tanh gate times sigmoid gate, softmax over the document's passages) weighs the
encodings, and a logistic unit scores the weighted sum.  Only document labels
teach; attention shows which passages decide.

The labelled sample is bounded (``TAUGHT``); every document is scored whole.

Defined cases: null, empty or wordless text -> one passage without words, whose
score is learned like any other's; labels of one class only -> the share of
class 1 (0 without labels) for all; repeated rows -> equal scores; rows without
an id are scored, held_out false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.llm.common import blocks, mix64
from jobsignal.llm.labelled import held_out, sample

#: At most so many labelled rows of class 0 and 1 teach.
TAUGHT = {0: 700, 1: 1400}
PASSAGE = 32
HIDDEN, GATE = 16, 8
STEPS = 120

LOWER, UPPER, DIGIT, STOP, SIGN, HIGH = range(6)
KIND = np.full(256, SIGN, np.int64)
KIND[ord("a"):ord("z") + 1] = LOWER
KIND[ord("A"):ord("Z") + 1] = UPPER
KIND[ord("0"):ord("9") + 1] = DIGIT
KIND[[ord(c) for c in ".,;:'\"-?()"]] = STOP
KIND[128:] = HIGH
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.append(np.zeros(1, np.uint64 if values.dtype == np.uint64 else np.int64), np.cumsum(values))
    return total[end] - total[first]


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one row of measures per passage, passages of each text); a text without words has one passage."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"\n".join(texts.to_pylist()) + b"\n", np.uint8)  # a text never runs into the next
    n = len(size)
    text_end = np.cumsum(size + 1)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(text_end, begin, side="right")
    words = np.bincount(owner, minlength=n)
    pieces = np.maximum(1, -(-words // PASSAGE))
    text = np.repeat(np.arange(n), pieces)
    k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(words) - words, pieces) + k * PASSAGE
    count = np.minimum(PASSAGE, words[text] - k * PASSAGE)
    stop = first + count
    length = end - begin
    kind = KIND[raw]
    kinds = [_sums(kind == c, begin, end) for c in range(6)]
    place = (np.arange(len(raw)) - np.repeat(begin, length_to(begin, len(raw)))) if len(begin) else np.zeros(len(raw), np.int64)
    code = _sums(mix64(raw.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8))), begin, end)
    passage = np.repeat(np.arange(len(text)), count)
    # distinct words of each passage: first of each (passage, word)
    order = np.lexsort((code, passage))
    fresh = np.r_[True, (code[order][1:] != code[order][:-1]) | (passage[order][1:] != passage[order][:-1])][: len(order)]
    distinct = np.bincount(passage[order][fresh], minlength=len(text))
    line = raw == 10
    breaks = np.add.reduceat(line[: text_end[-1]], np.minimum(begin_of(first, begin, text_end, text), len(raw) - 1)) if len(text) else np.zeros(0)
    c = np.maximum(count, 1)
    chars = np.maximum(_sums(length, first, stop), 1)
    letters = np.maximum(kinds[LOWER] + kinds[UPPER] + kinds[HIGH], 1)
    rows = [count / PASSAGE, chars / c / 10, distinct / c, np.minimum(breaks / c, 3)]
    rows += [_sums(x, first, stop) / chars for x in kinds]
    rows += [_sums(x, first, stop) / c for x in (
        (kinds[UPPER] >= 0.8 * letters) & (length > 1), kinds[SIGN] == length, kinds[SIGN] > 0, kinds[STOP] == length,
        kinds[DIGIT] > 0, length == 1, length > 20, KIND[raw[np.maximum(end - 1, 0)]] == STOP, KIND[raw[np.minimum(begin, len(raw) - 1)]] == UPPER)]
    rows += [np.log1p(words[text]) / 8]
    return np.stack(rows, 1), pieces


def length_to(begin: np.ndarray, n: int) -> np.ndarray:
    """How many bytes count from each word's start: up to the next word (the first takes what stands before it)."""
    bounds = np.append(begin, n)
    out = np.diff(bounds)
    out[0] += begin[0]
    return out


def begin_of(first: np.ndarray, begin: np.ndarray, text_end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Byte at which each passage starts; a text without words starts at its own first byte."""
    start = np.append(0, text_end)[text]
    at = np.append(begin, text_end[-1])[np.minimum(first, len(begin))]
    return np.where(at < text_end[text], np.maximum(at, start), start)


class Attention:
    """Gated attention over the passages of a bag, and a logistic unit on the weighted encoding."""

    def __init__(self, dims: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.share, self.trained = np.zeros(dims), np.ones(dims), 0.0, False
        self.p = {"w": r.normal(0, dims ** -0.5, (dims, HIDDEN)), "b": np.zeros(HIDDEN), "v": r.normal(0, 0.3, (HIDDEN, GATE)), "u": r.normal(0, 0.3, (HIDDEN, GATE)),
                  "a": r.normal(0, 0.3, GATE), "o": r.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}

    def forward(self, x: np.ndarray, pieces: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(pieces) - pieces
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (tv * su) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), pieces))
        weight = e / np.repeat(np.add.reduceat(e, first), pieces)
        z = np.add.reduceat(h * weight[:, None], first)
        return {"x": x, "h": h, "tv": tv, "su": su, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"][0], -60, 60)))}

    def gradients(self, f: dict[str, np.ndarray], pieces: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(pieces) - pieces
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d, pieces)[:, None] * p["o"]
        dw = (dz * f["h"]).sum(1)
        de = f["weight"] * (dw - np.repeat(np.add.reduceat(f["weight"] * dw, first), pieces))
        dt = de[:, None] * p["a"] * f["su"] * (1 - f["tv"] ** 2)
        ds = de[:, None] * p["a"] * f["tv"] * f["su"] * (1 - f["su"])
        dh = (dz * f["weight"][:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["tv"] * f["su"]).T @ de, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, pieces: np.ndarray, y: np.ndarray) -> Attention:
        self.share = float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) < 2:
            return self
        self.trained, self.mean, self.scale = True, x.mean(0), x.std(0) + 1e-3
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            grads = self.gradients(self.forward(x, pieces), pieces, y)
            for k, (m, v) in moments.items():
                g = grads[k] + 1e-4 * self.p[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.p[k] = self.p[k] - 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.share)
        x, pieces = measures(texts)
        return self.forward(x, pieces)["score"] if len(pieces) else np.zeros(0)


def train(rows: list[tuple[str, int]]) -> Attention:
    x, pieces = measures(pa.array([r[0] for r in rows] or [""]))
    return Attention(x.shape[1]).fit(x, pieces[: len(rows)], np.array([float(r[1]) for r in rows]))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row of ``docs``."""
    model = spark.sparkContext.broadcast(train(sample(docs, labels, "quality", TAUGHT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(part.column(1)), pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
