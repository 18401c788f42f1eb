"""Operator 8: benchmark decontamination by a distributed positional inverted index.

Test items give windows of ``WINDOW`` words (a shorter item is one window).  One
pass over all documents counts the test terms; windows with a term that no
document holds cannot occur.  A second pass stores postings (term, document,
positions) of the rarest two terms of each remaining window.  The offset-adjusted
lists are then intersected, rarest term first: equal starts are candidates for
the phrase, starts at most ``slop`` apart are proximity matches.  Candidates are
held against the whole window in the document's own words, so phrases are exact.

Benchmarks are taken in blocks of bounded size, so vocabulary and windows that
workers receive have a bound whatever the benchmark; postings and candidates
stay in tables and grow with the data.

Defined cases: null or wordless text -> 0 words, no hits, not contaminated; a
null or wordless item gives no window; rows sharing an item_id are one item, a
null item_id counts as an item named ""; repeated rows -> equal results; rows
without a doc_id are judged like all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.llm.common import Tables, blocks

WINDOW = 13
#: Bytes of benchmark text whose windows are sent to workers at once.
BLOCK_BYTES = 4 << 20
#: Fixed by the contract: 0-9, a-z and bytes from 0x80 are word bytes, A-Z count as a-z.
WORD_BYTES = bytes(c if c in range(0x30, 0x3A) or c in range(0x61, 0x7B) or c >= 0x80 else c + 32 if c in range(0x41, 0x5B) else 0x20 for c in range(256))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each place, words of each text)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    raw = b"".join(texts.cast(pa.large_binary()).to_pylist()).translate(WORD_BYTES)
    offsets = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    split = pc.ascii_split_whitespace(spaced)
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    at = split.offsets.to_numpy()
    coded = flat.filter(real).cast(pa.large_binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends[at - at[0]])


def words_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _windows(items: list[tuple[str, str]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Items that hold each window."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_list(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[i:i + window]), set()).add(item)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key (kid, h) without nulls; rows that share it have the same text and so the same result."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("kid"), F.xxhash64(text, F.length(text)).alias("h"), text.alias("text"))


def _column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Occurrences of each term in all documents; what the driver gets is bounded by the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(sent.value, pa.large_binary())
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                known, at, _ = words_of(_column(part, "text"))
                term = pc.fill_null(pc.index_in(known, terms), len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)
                total += np.bincount(term[at], minlength=len(total)) if len(at) else 0
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["term"]]: r["n"] for r in rows}


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """One row per document: doc_id, kid, h, n_words and the places of the terms (parallel arrays term, pos)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.large_binary())
        for batch in batches:
            for part in blocks(batch, "text"):
                known, at, count = words_of(_column(part, "text"))
                term = pc.fill_null(pc.index_in(known, wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = term[at] if len(at) else at
                text = np.repeat(np.arange(len(count)), count)
                pos = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                hit = term >= 0
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(text[hit], minlength=len(count)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[hit], pa.int32())) for x in (term, pos)]
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), _column(part, "kid"), _column(part, "h"), pa.array(count, pa.int64()), *lists],
                                                 names=["doc_id", "kid", "h", "n_words", "term", "pos"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, kid long, h long, n_words long, term array<int>, pos array<int>")


def _hits(spark: SparkSession, tables: Tables, docs: DataFrame, items: list[tuple[str, str]], window: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """(index, hits): per document with matches its spans, items and items near."""
    held = _windows(items, window)
    count = term_counts(docs, sorted({w for p in held for w in p}))
    possible = [p for p in held if all(w in count for w in p)]
    rows, places = [], {}
    for k, phrase in enumerate(possible):
        order = sorted(range(len(phrase)), key=lambda i: (count[phrase[i]], i))
        first, second = order[0], order[min(1, len(order) - 1)]
        t1, t2 = (places.setdefault(phrase[i], len(places)) for i in (first, second))
        rows.append((k, t1, first, t2, second))
    index = tables.save(postings(docs, list(places)))
    lists = index.select("kid", "h", F.inline(F.arrays_zip("term", "pos")))
    rarest = spark.createDataFrame(rows, "w int, t1 int, o1 int, t2 int, o2 int")
    a = (lists.join(rarest.select("w", F.col("t1").alias("term"), "o1"), "term")
         .select("kid", "h", "w", (F.col("pos") - F.col("o1")).alias("start")))
    b = (lists.join(rarest.select("w", F.col("t2").alias("term"), "o2"), "term")
         .select("kid", "h", "w", (F.col("pos") - F.col("o2")).alias("other")))
    # cells of slop + 1 words keep the comparison of near starts linear in the postings
    cell = slop + 1
    a = a.withColumn("cell", F.floor(F.col("start") / cell))
    b = b.withColumn("cell", F.explode(F.array(*[F.floor(F.col("other") / cell) + d for d in ((-1, 0, 1) if slop else (0,))])))
    near = (a.join(b, ["kid", "h", "w", "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
            .groupBy("kid", "h", "w", "start").agg(F.max((F.col("start") == F.col("other")).cast("int")).alias("exact")))
    found = near.groupBy("kid", "h").agg(F.collect_list(F.when((F.col("exact") == 1) & (F.col("start") >= 0), F.struct("w", "start"))).alias("found"), F.collect_set("w").alias("near"))
    sent = spark.sparkContext.broadcast(([b" ".join(p) for p in possible], [len(p) for p in possible], [sorted(held[p]) for p in possible]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase, size, owners = sent.value
        for batch in batches:
            for part in blocks(batch, "text"):
                spans, own, close = [], [], []
                for text, cands, ws in zip(_column(part, "text").to_pylist(), _column(part, "found").to_pylist(), _column(part, "near").to_pylist()):
                    words = words_list(text)
                    true = [(c["start"], c["w"]) for c in cands if b" ".join(words[c["start"]:c["start"] + size[c["w"]]]) == phrase[c["w"]]]
                    spans.append([{"s": s, "e": s + size[w]} for s, w in sorted(true)])
                    own.append(sorted({i for _, w in true for i in owners[w]}))
                    close.append(sorted({i for w in ws for i in owners[w]}))
                span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                yield pa.RecordBatch.from_arrays([_column(part, "kid"), _column(part, "h"), pa.array(spans, span), pa.array(own, pa.list_(pa.string())), pa.array(close, pa.list_(pa.string()))],
                                                 names=["kid", "h", "spans", "items", "close"])

    hits = (docs.select("kid", "h", "text").join(found, ["kid", "h"])
            .mapInArrow(verify, "kid long, h long, spans array<struct<s:int,e:int>>, items array<string>, close array<string>"))
    return index, hits


def _judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, slop: int) -> DataFrame:
    tables = Tables(spark, "decontaminate")
    docs = _keyed(docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // BLOCK_BYTES
    index, parts = None, []
    for k in range(n):
        block = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()]
        own, hits = _hits(spark, tables, docs, block, window, slop)
        index = index if index is not None else own
        parts.append(hits)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")), lambda acc: acc["n"])
    merged = hits.groupBy("kid", "h").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                          F.size(F.array_distinct(F.flatten(F.collect_list("close")))).cast("long").alias("n_near"))
    out = index.select("doc_id", "kid", "h", "n_words").join(merged, ["kid", "h"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "kid", "h", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
                      F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near counts items with a proximity match."""
    return _judged(spark, docs, benchmark, window, slop).drop("kid", "h")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; every row is judged by its own text."""
    bad = _judged(spark, docs, benchmark, WINDOW, 0).where("contaminated").select(F.col("kid").alias("_dc_kid"), F.col("h").alias("_dc_h")).distinct()
    text = F.col("text").cast("string")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)) == F.col("_dc_kid")) & (F.xxhash64(text, F.length(text)) == F.col("_dc_h"))
    return docs.join(bad, same, "left_anti")
