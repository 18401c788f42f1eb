"""Operator 11: language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the words of a text (A-Z lower-cased, maximal runs other than
``[\\x20\\x09-\\x0D]``) and one end.  Three passes read the corpus:

1. Every token of every teaching document is counted (partial counts per block,
   summed by Spark).
2. The model is trained on every teaching document.  Its outputs are ``UNITS``
   units: the end, the most frequent words, and classes of all other words by their
   last two bytes.  The ``CONTEXT`` units before a token predict a vector, the
   elementwise products of their vectors with a weight vector per place, and a
   unit's logit is that vector's product with the unit's own plus a bias.  Each
   task trains on its documents by noise-contrastive estimation (noise: unigram
   units, shared in a minibatch); Spark averages the tasks' models by tokens.  The
   corpus is dealt over ``ROUNDS`` rounds, so each document teaches once.
3. Every document is scored: batched matrix products give the logits of all
   units, and their exact softmax the log-probability of each token's unit.  A
   word inside a class has its share of the class, (c + 0.1) over the class's sum,
   where one unknown word per class has c = 0; so the probabilities of all known
   words, the end and the unknown ones sum to 1.

Counts of at most ``FREQUENT`` of the most frequent words go to the workers (words longer than
64 bytes are keyed by their SHA-256, so that table is bounded by bytes); all other
words of a document join the count table by a shuffle, each distinct word of a
document once.  A word of that shuffle is by rank beyond ``FREQUENT``, so none is hot.

Defined cases: null text is the empty one (its only token is the end); rows
without a doc_id don't teach, held_out is false; repeated rows are scored alike and
each teaches; no teaching rows: N = V = 0 and all tokens are unknown; no
documents, no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsignal.llm.common import Tables, blocks, mix64, release

UNITS = 256
CLASSES = 96
CONTEXT = 3
WIDTH = 16
NOISE = 25
MINIBATCH = 1024
ROUNDS = 2
RATE = 0.1
FREQUENT = 1 << 17
LONGEST_KEY = 64
#: Key of the end token; no word is empty.
END = ""
ADDED = 0.1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct keys, number of the key at each word's place, words of each text)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    count = np.diff(ends[words.offsets.to_numpy() - words.offsets[0].as_py()])
    coded = flat.filter(real).dictionary_encode()
    keys = coded.dictionary
    long = np.flatnonzero(pc.greater(pc.binary_length(keys), LONGEST_KEY).to_numpy(zero_copy_only=False))
    if len(long):
        out = keys.to_pylist()
        for i in long.tolist():
            out[i] = " " + hashlib.sha256(out[i].encode()).hexdigest()
        keys = pa.array(out, pa.string())
    return keys, coded.indices.to_numpy(zero_copy_only=False), count


def word_class(keys: pa.Array) -> np.ndarray:
    """Class of each word, from its last two bytes."""
    if not len(keys):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4).astype(np.int64)
    raw = np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)
    last = raw[offsets[1:] - 1].astype(np.uint64)
    before = np.where(np.diff(offsets) > 1, raw[np.maximum(offsets[1:] - 2, 0)], 0).astype(np.uint64)
    return (mix64(before * np.uint64(256) + last + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


@dataclass
class Vocabulary:
    """Counts of frequent words, units, and the sums of the classes; all of bounded size."""

    words: pa.Array  # most frequent first
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    class_sum: np.ndarray  # of c + ADDED over a class's words, and ADDED for its unknown one

    @property
    def own(self) -> int:
        """Number of words with a unit of their own (unit 0 is the end)."""
        return min(UNITS - CLASSES - 1, len(self.words))

    def unit_mass(self) -> np.ndarray:
        out = np.zeros(UNITS)
        out[0] = self.ends + ADDED
        out[1:1 + self.own] = self.counts[: self.own] + ADDED
        out[UNITS - CLASSES:] = self.class_sum
        return out

    def units(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit, rank among the frequent words or -1) of each key."""
        rank = pc.fill_null(pc.index_in(keys, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where((rank >= 0) & (rank < self.own), rank + 1, UNITS - CLASSES + word_class(keys)), rank


@dataclass
class Model:
    """vectors: units as context; place: weight vector of each place; out, bias: units as outputs."""

    vectors: np.ndarray
    place: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(mass: np.ndarray, seed: int = 11) -> Model:
        """Unigram units: the outputs' vectors are 0, the biases log shares (units that never occur are out)."""
        r = np.random.default_rng(seed)
        with np.errstate(divide="ignore"):
            bias = np.where(mass > 0, np.log(mass / max(mass.sum(), 1e-9)), -1e9)
        return Model(r.normal(0, 0.3, (UNITS, WIDTH)).astype(np.float32), (1 + r.normal(0, 0.1, (CONTEXT, WIDTH))).astype(np.float32),
                     np.zeros((UNITS, WIDTH), np.float32), bias.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.place, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def unflat(self, values: np.ndarray) -> Model:
        at, out = 0, []
        for x in self.parts():
            out.append(values[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Predicted vectors of rows of ``CONTEXT`` units."""
        out = self.vectors[context[:, 0]] * self.place[0]
        for k in range(1, CONTEXT):
            out += self.vectors[context[:, k]] * self.place[k]
        return out

    def log_probabilities(self, context: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each unit after its context."""
        logits = self.hidden(context) @ self.out.T
        logits += self.bias
        top = logits.max(1)
        said = logits[np.arange(len(unit)), unit] - top
        logits -= top[:, None]
        np.exp(logits, out=logits)
        return said - np.log(logits.sum(1))


def contexts(unit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``CONTEXT`` units before each token, the nearest first; before a text's first token stand ends."""
    starts = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(unit)) - starts
    out = np.zeros((len(unit), CONTEXT), np.int16)
    for k in range(1, CONTEXT + 1):
        out[k:, k - 1] = np.where(place[k:] >= k, unit[: len(unit) - k], 0)
    return out


def row_sums(index: np.ndarray, rows: np.ndarray, height: int) -> np.ndarray:
    """Sums of the rows of each index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    out = np.zeros((height, rows.shape[1]), np.float32)
    out[index[first]] = np.add.reduceat(rows[order], first)
    return out


def gradients(model: Model, context: np.ndarray, unit: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean noise-contrastive loss; ``log_noise``: log of len(noise) times each unit's noise probability."""
    h = model.hidden(context)
    true = np.einsum("ij,ij->i", h, model.out[unit]) + model.bias[unit] - log_noise[unit]
    false = h @ model.out[noise].T + (model.bias[noise] - log_noise[noise])
    n = np.float32(len(unit))
    g_true = -1 / (1 + np.exp(np.clip(true, -30, 30))) / n
    g_false = 1 / (1 + np.exp(-np.clip(false, -30, 30))) / n
    g_h = g_true[:, None] * model.out[unit] + g_false @ model.out[noise]
    index = np.concatenate([unit, noise]).astype(np.int16)
    both = row_sums(index, np.concatenate([np.c_[g_true[:, None] * h, g_true], np.c_[g_false.T @ h, g_false.sum(0)]]).astype(np.float32), UNITS)
    place = np.stack([(g_h * model.vectors[context[:, k]]).sum(0) for k in range(CONTEXT)])
    vectors = row_sums(context.T.ravel(), np.concatenate([g_h * model.place[k] for k in range(CONTEXT)]), UNITS)
    return [vectors, place, both[:, :-1], both[:, -1]]


class Trainer:
    """Minibatch steps with rates that fall with each weight's squared gradients; goes on from block to block of a task."""

    def __init__(self, model: Model, mass: np.ndarray, seed: int):
        self.model = model.unflat(model.flat())
        self.r = np.random.default_rng(seed)
        share = mass / mass.sum()
        self.cumulated = np.cumsum(share)
        with np.errstate(divide="ignore"):
            self.log_noise = np.where(share > 0, np.log(NOISE * share), 0).astype(np.float32)
        self.squares = [np.full_like(x, 1e-6) for x in self.model.parts()]
        self.tokens = 0

    def teach(self, context: np.ndarray, unit: np.ndarray) -> None:
        order = self.r.permutation(len(unit))
        for a in range(0, len(order), MINIBATCH):
            at = order[a:a + MINIBATCH]
            noise = np.minimum(np.searchsorted(self.cumulated, self.r.random(NOISE), side="right"), UNITS - 1)
            grads = gradients(self.model, context[at], unit[at], noise, self.log_noise)
            for value, square, g in zip(self.model.parts(), self.squares, grads):
                square += g * g
                value -= RATE * g / np.sqrt(square)
        self.tokens += len(unit)


def unit_rows(vocabulary: Vocabulary, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their units, their ranks, key of each word, words of each text, unit of each token, tokens of each text)."""
    keys, at, count = split_words(texts)
    of_key, rank = vocabulary.units(keys)
    n = count + 1
    unit = np.zeros(int(n.sum()), np.int16)
    is_word = np.ones(len(unit), bool)
    is_word[np.cumsum(n) - 1] = False
    unit[is_word] = of_key[at]
    return keys, of_key, rank, at, count, unit, n


def counted(teaching: DataFrame) -> DataFrame:
    """(key, c): how often each token occurs; the end has the key ``END``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 8 << 20):
                keys, at, count = split_words(part.column("text"))
                c = np.append(np.bincount(at, minlength=len(keys)), len(count))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([keys, pa.array([END])]), pa.array(c, pa.int64())], names=["key", "c"])

    return teaching.select("text").mapInArrow(run, "key string, c long").groupBy("key").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What the workers need of the counts: at most ``FREQUENT`` keys of 65 bytes and one sum per class reach the driver."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("key") == END, F.col("c"))).alias("ends")).first()
    # the words above a bound on their count; the bound comes from a histogram of fixed size, so no task or driver sorts the vocabulary
    size = F.floor(F.log2("c") * 32).cast("int")
    words, top = counts.where(F.col("key") != END), []
    histogram = sorted(((r["b"], r["n"]) for r in words.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    fits = np.cumsum([n for _, n in histogram]) <= FREQUENT
    if fits.any():
        top = words.where(size >= histogram[int(fits.sum()) - 1][0]).collect()
        top.sort(key=lambda r: (-r["c"], r["key"]))
    out = Vocabulary(pa.array([r["key"] for r in top], pa.string()), np.array([r["c"] for r in top], np.int64), total["ends"] or 0, total["n"] or 0, total["v"], np.zeros(0))
    own = [r["key"] for r in top[: out.own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = word_class(batch.column("key"))
            c = np.bincount(which, batch.column("c").to_numpy(), minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(c.astype(np.int64)), pa.array(np.bincount(which, minlength=CLASSES))],
                                             names=["k", "c", "n"])

    rest = counts.where((F.col("key") != END) & ~F.col("key").isin(own)).mapInArrow(run, "k int, c long, n long")
    out.class_sum = np.full(CLASSES, ADDED)
    for r in rest.groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        out.class_sum[r["k"]] += r["c"] + ADDED * r["n"]
    return out


def trained(spark: SparkSession, teaching: DataFrame, known: Vocabulary) -> Model:
    """The model after all rounds; each round's tasks start from the average before it."""
    model = Model.start(known.unit_mass())
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((known, model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, before = sent.value
            trainer = None
            for batch in batches:
                for part in blocks(batch, "text"):
                    *_, unit, n = unit_rows(words, part.column("text"))
                    trainer = trainer or Trainer(before, words.unit_mass(), len(unit))
                    trainer.teach(contexts(unit, n), unit)
            if trainer:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([trainer.model.flat().astype(float).tolist()], pa.list_(pa.float64()))],
                                                 names=["tokens", "w"])
            release()

        share = teaching.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == turn).select("text")
        parts = share.mapInArrow(run, "tokens long, w array<double>")
        mean = (parts.select("tokens", F.posexplode("w").alias("i", "w")).groupBy("i")
                .agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w")).collect())
        if mean:
            values = np.zeros(len(mean))
            values[[r["i"] for r in mean]] = [r["w"] for r in mean]
            model = model.unflat(values)
        sent.unpersist()
    return model


LOCAL = ("uid long, doc_id {id}, held_out boolean, n_tokens long, known long, base double, score double, rest long, "
         "words array<struct<key:string,n:long>>")


def scored(spark: SparkSession, docs: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """Per row what its task can tell: all but the counts of its rare words, which are listed."""
    sent = spark.sparkContext.broadcast((known, model))
    schema = T.StructType.fromDDL(LOCAL.format(id="long"))
    schema["doc_id"].dataType = docs.schema["doc_id"].dataType
    docs = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = sent.value
        mass = vocabulary.unit_mass()
        log_class = np.log10(np.where(mass > 0, mass, 1))
        log_all = np.log10(vocabulary.tokens + ADDED * (vocabulary.distinct + 1))
        log_count = np.log10(vocabulary.counts + ADDED)
        end = np.log10(vocabulary.ends + ADDED) - log_all
        for batch in batches:
            for part in blocks(batch, "text"):
                keys, of_key, rank, at, count, unit, n = unit_rows(vocabulary, part.column("text"))
                context = contexts(unit, n)
                said = np.zeros(len(unit))
                for a in range(0, len(unit), 4096):
                    said[a:a + 4096] = model.log_probabilities(context[a:a + 4096], unit[a:a + 4096])
                score = np.add.reduceat(said, np.cumsum(n) - n) / np.log(10)
                row = np.repeat(np.arange(len(count)), count)
                # words of a class: the share of the class; counts of the frequent ones are here
                frequent = rank >= 0
                value = np.where(frequent, log_count[np.maximum(rank, 0)] if len(log_count) else 0.0, 0.0)
                inside = np.where(of_key >= UNITS - CLASSES, value - log_class[of_key], 0.0)
                score += np.bincount(row, inside[at], minlength=len(count))
                base = np.bincount(row, np.where(frequent, value - log_all, -log_all)[at], minlength=len(count)) + end
                sure = np.bincount(row, frequent[at], minlength=len(count)).astype(np.int64) + (vocabulary.ends > 0)
                rare = ~frequent[at]
                pair, times = np.unique(row[rare] * max(len(keys), 1) + at[rare], return_counts=True)
                of_row = np.bincount(pair // max(len(keys), 1), minlength=len(count))
                listed = pa.StructArray.from_arrays([keys.take(pa.array(pair % max(len(keys), 1))), pa.array(times, pa.int64())], names=["key", "n"])
                words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of_row)), pa.int32()), listed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(sure), pa.array(base), pa.array(score),
                     pa.array(np.bincount(row[rare], minlength=len(count)).astype(np.int64)), words], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    tables = Tables(spark, "lm")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    teaching = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    counts = tables.save(counted(teaching))
    known = vocabulary(counts)
    model = trained(spark, teaching, known)
    local = tables.save(scored(spark, docs, known, model))
    rare = local.select("uid", F.inline("words"))
    rest = (rare.join(counts, "key", "left").groupBy("uid")
            .agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADDED))).alias("logs"),
                 F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("found")))
    out = local.drop("words").join(rest, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
                      F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
