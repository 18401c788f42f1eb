"""Labelled rows for the two classifiers: which may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest text, in characters, that the sample takes; longer texts are scored like all others.
LONGEST_TAUGHT = 50_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that must not teach: crc32 of the id's text, modulo 5, is 0 (rows without an id don't teach either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class[c]`` labelled rows of each class c, chosen by a hash of the id.

    A document labelled twice counts with its larger label; null labels teach
    nothing; of several texts under one id the one with the smallest hash teaches,
    however the rows are split.  The row bound times ``LONGEST_TAUGHT`` bounds what the driver gets.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    ids = None
    for c, n in per_class.items():
        part = known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.union(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, LONGEST_TAUGHT))
    hashed = F.struct(F.xxhash64("text"), "text")
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", hashed).alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
