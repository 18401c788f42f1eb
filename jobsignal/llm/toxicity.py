"""Operator 6: toxicity by averaged sub-word vectors and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 6 bytes of the
lower-cased word between marks, hashed into a table), a passage the mean of its
words (short ones are filled up with zeros), and a linear softmax gives the passage's classes.  Vectors and softmax
are trained together.  A document is as toxic as its worst passage: training
starts with every passage under its document's label and then goes on with the
passage of each document that scores highest at that moment, and, at a small
weight, the others of clean documents.

The labelled sample is bounded (``TAUGHT``); every document is scored whole.

Defined cases: texts without words -> 0, as no passage speaks; no labelled rows of
one class -> 0 for all, as nothing tells toxic texts from others;
repeated rows -> equal scores; rows without an id are scored, held_out false.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsignal.llm.common import blocks, mix64
from jobsignal.llm.labelled import held_out, sample

#: At most so many labelled rows of class 0 and 1 teach.
TAUGHT = {0: 1600, 1: 1000}
PASSAGE = 8
BUCKETS = 1 << 17
DIMS = 4
GRAMS = (3, 4, 5, 6)
STEPS = (10, 70)
RATE = 0.1
#: Weight of a clean document's other passages beside its worst.
EASY = 0.02
DECAY = 1e-6
#: Words of fewer taught texts do not teach.
SEEN = 2


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each place, words of each text); a word repeated at once counts once."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    count = np.diff(ends[words.offsets.to_numpy() - words.offsets[0].as_py()])
    coded = flat.filter(real).dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(count)), count)
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])][: len(at)]
    return coded.dictionary.cast(pa.binary()).to_pylist(), at[new], np.bincount(text[new], minlength=len(count))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the n-grams of all words in a row, number of n-grams of each word)."""
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # bytes left in the word
    word = np.repeat(np.arange(len(words)), size)
    code = np.zeros(len(raw), np.uint64)
    found, owner = [], []
    for j in range(max(GRAMS)):
        code[: len(raw) - j] = code[: len(raw) - j] * np.uint64(0x100000001B3) + raw[j:] + np.uint64(1)
        if j + 1 in GRAMS:
            ok = left > j
            found.append((mix64(code[ok] + np.uint64(j)) >> np.uint64(64 - 17)).astype(np.int64))
            owner.append(word[ok])
    owner_, found_ = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner_, kind="stable")
    return found_[order], np.bincount(owner_, minlength=len(words))


def passages(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each passage, its size, its text); words stand in a row."""
    pieces = -(-count // PASSAGE)
    text = np.repeat(np.arange(len(count)), pieces)
    k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(count) - count, pieces) + k * PASSAGE
    return first, np.minimum(PASSAGE, count[text] - k * PASSAGE), text


class Means:
    """Rows as means of other rows: ``index`` lists them (by row), ``size`` is what each row's sum is divided by."""

    def __init__(self, index: np.ndarray, row: np.ndarray, size: np.ndarray, width: int):
        self.index, self.row, self.width = index, row, width
        self.weight = (1 / np.maximum(size, 1)).astype(np.float32)[:, None]
        self.back = np.argsort(index, kind="stable")
        self.row_back = row[self.back]
        self.rows, self.first = np.unique(row, return_index=True)
        self.cols, self.first_back = np.unique(index[self.back], return_index=True)

    def forward(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.weight), x.shape[1]), np.float32)
        out[self.rows] = np.add.reduceat(x[self.index], self.first)
        return out * self.weight

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, g.shape[1]), np.float32)
        out[self.cols] = np.add.reduceat((g * self.weight)[self.row_back], self.first_back)
        return out


@dataclass
class Model:
    """Margin (toxic minus not) of each bucket, and the bias."""

    margin: np.ndarray
    bias: float
    trained: bool = True

    def score(self, texts: pa.Array) -> np.ndarray:
        words, at, count = split_words(texts)
        out = np.zeros(len(count))
        if not self.trained or not len(at):
            return out
        index, size = grams(words)
        per_word = np.add.reduceat(self.margin[index], np.cumsum(size) - size) / size
        first, _, text = passages(count)
        margin = np.add.reduceat(per_word[at], first) / PASSAGE + self.bias
        some = count > 0
        worst = np.maximum.reduceat(margin, np.flatnonzero(np.r_[True, text[1:] != text[:-1]]))
        out[some] = 1 / (1 + np.exp(-np.clip(worst, -500, 500)))
        return out


def train(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, False)
    words, at, count = split_words(pa.array([r[0] for r in rows]))
    first, n, text = passages(count)
    doc = np.repeat(np.arange(len(count)), count)
    seen = np.bincount(np.unique(at * len(count) + doc) // len(count), minlength=len(words))
    taught = np.flatnonzero(seen >= min(SEEN, max(1, len(rows) // 100)))  # a word of one text tells nothing about others
    number = np.full(len(words), -1)
    number[taught] = np.arange(len(taught))
    index, size = grams([words[i] for i in taught])
    to_word = Means(index, np.repeat(np.arange(len(taught)), size), size, BUCKETS)
    used = number[at] >= 0
    to_passage = Means(number[at][used], np.repeat(np.arange(len(n)), n)[used], np.full(len(n), PASSAGE), len(taught))
    label = y[text]
    r = np.random.default_rng(seed)
    vectors, soft, bias = (x.astype(np.float32) for x in (r.normal(0, 0.05, (BUCKETS, DIMS)), r.normal(0, 0.5, (DIMS, 2)), np.zeros(2)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, soft, bias)]
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    for step in range(1, sum(STEPS) + 1):
        hidden = to_passage.forward(to_word.forward(vectors))
        logits = hidden @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = np.ones(len(text), np.float32)
        if step > STEPS[0]:
            best = np.repeat(np.maximum.reduceat(p[:, 1], starts), np.diff(np.append(starts, len(text))))
            weight[p[:, 1] < best] = 0
            weight[(label == 0) & (weight == 0)] = EASY
        weight /= np.where(label == 1, 2 * weight[label == 1].sum(), 2 * weight[label == 0].sum())
        g = (p - np.eye(2, dtype=np.float32)[label]) * weight[:, None]
        grads = (to_word.backward(to_passage.backward(g @ soft.T)) + DECAY * vectors, hidden.T @ g, g.sum(0))
        for value, grad, (m, v) in zip((vectors, soft, bias), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels, "toxic", TAUGHT))


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_toxic_score`` of each row's text."""
    sent = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "_toxic_score"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = part.column(part.schema.get_field_index("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(texts), pa.float64())], names=[*keep, "_toxic_score"])

    return docs.select(*keep).mapInArrow(run, schema)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row of ``docs``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = scored(spark, docs, learn(docs, labels)).withColumnRenamed("_toxic_score", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
