"""Operator 12: what each filter of a chain removes, alone and in every order, by a Gray-code walk over filter subsets.

Every document gets a mask of the filters it fails, and documents are counted
per (part, mask): at most 32 cells a part, whatever the size of the corpus.  The
walk then visits all subsets of the filters in Gray-code order, so that one
filter is switched on or off at a time; each cell holds the number of active
filters that it fails, and only cells whose counter leaves or reaches 0 change the
running survivors.  The 32 states are stored; a step of any order is the
difference of two of them.

Filters (words: maximal runs other than ``[\\x20\\x09-\\x0D]``, case-sensitive):
A fewer than 200 words; B distinct words under half of the words; C more than 3 %
of the code points are ``[A-Z]``; D one of ``#$%&*|``; E the text is that of a
smaller doc_id.  Texts are compared by their SHA-256 digest.

Defined cases: a null text is the empty one (it fails A, and E if a smaller
doc_id is empty or null too); a null lang is the part ''; rows without a doc_id
are counted, fail E never and make no other row fail it, and have no labels;
rows of the same doc_id are each a document and don't make one another fail E;
a document with several label rows is good (toxic) if one of them says so; null
labels say nothing; no documents, no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
SALTS = 8
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.split(text, SPACES)
    first, last = (F.element_at(words, 1) == "").cast("int"), ((F.element_at(words, -1) == "") & (F.size(words) > 1)).cast("int")
    n = (F.size(words) - first - last).cast("long")
    distinct = (F.size(F.array_distinct(words)) - F.greatest(first, last)).cast("long")
    capitals = F.length(text).cast("long") - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    docs = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), digest.alias("digest"), text_mask(text).alias("mask"))
    docs = docs.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.pmod(F.xxhash64("digest"), F.lit(SALTS))))
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))))
    # labels are dealt, whatever the size of their file: Spark does not count what they hold SALTS times over, and would send it all through the driver
    known = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")).hint("merge")
    # rows of one document and text, then those of one text and part: only a part's rows of a text, never its documents, meet in a window
    rows = (docs.join(known, ["doc_id", "salt"], "left").groupBy("doc_id", "salt", "digest", "mask", "part")
            .agg(F.count("*").alias("n"), F.max(F.coalesce("good", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    some = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "mask", "part").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("no_id"), F.min(F.when(some, F.struct("doc_id", "n", "good", "toxic"))).alias("first"))
    leads = F.coalesce(F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest")), F.lit(False))
    texts = texts.select("part", "mask", *COUNTS, "no_id", "first", leads.alias("leads"))
    lead = {"n": F.col("no_id") + F.when(F.col("leads"), F.col("first.n")).otherwise(0),
            **{c: F.when(F.col("leads"), F.col("first.n") * F.col(f"first.{c}")).otherwise(0) for c in COUNTS[1:]}}
    sums = texts.groupBy("part", "mask").agg(*(F.sum(lead[c]).alias(f"{c}0") for c in COUNTS), *(F.sum(F.col(c) - lead[c]).alias(f"{c}1") for c in COUNTS))
    both = F.explode(F.array(*(F.struct((F.col("mask") + 16 * e).alias("mask"), *(F.col(f"{c}{e}").alias(c) for c in COUNTS)) for e in (0, 1))))
    return sums.select("part", both.alias("c")).select("part", "c.*").where("n > 0")


def walk(masks: np.ndarray, counts: np.ndarray, filters: int = len(LETTERS)) -> np.ndarray:
    """Survivors of every subset of the filters: one row of ``counts`` sums per subset (its bits are its index)."""
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)
    running = counts.sum(0)
    states[0] = running
    subset = 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        hit = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            running = running - counts[hit & (failing == 0)].sum(0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[hit & (failing == 0)].sum(0)
        states[subset] = running
    return states


def steps(states: np.ndarray, letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders, from the stored states."""
    k, everything = len(letters), len(states) - 1
    fails = [int(states[0][0] - states[1 << i][0]) for i in range(k)]
    unique = [int(states[everything ^ 1 << i][0] - states[everything][0]) for i in range(k)]
    shapley = [sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(states[s][0] - states[s | 1 << i][0])
                   for s in range(1 << k) if not s >> i & 1) for i in range(k)]
    for order in permutations(range(k)):
        on = 0
        for step, i in enumerate(order, 1):
            lost = [int(x) for x in states[on] - states[on | 1 << i]]
            on |= 1 << i
            yield "".join(letters[j] for j in order), step, int(states[on][0]), lost[0], fails[i] - lost[0], unique[i], lost[1], lost[2], shapley[i]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                masks = np.array([c["mask"] for c in row["cells"]], np.int64)
                counts = np.array([[c[x] for x in COUNTS] for c in row["cells"]], np.int64)
                rows = list(steps(walk(masks, counts)))
                types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                                                 names=[x.split()[0] for x in OUT.split(", ")])

    return parts.mapInArrow(run, OUT)
