"""Operator 2: line dedup by content-defined chunks, in DataFrame functions only.

Every line has a hash, a rolling hash over two neighbouring lines decides
whether a chunk ends there, so a passage that moves within or between documents
falls into the same chunks.  Of chunks of two lines or more that occur more than
once in the whole table, the first (smallest doc_id, then place) stays and the
others go, after their bytes have been compared with the first's.

Chunk hashes are counted with partial sums, repeated ones are joined back (a join
that Spark can split where one hash holds many rows), and only texts of repeated
chunks are compared.  The two joins to whole documents are always sort-merge
joins: what they join has no bound, and so the plan is alike at every size.

Defined cases: null text stays null, empty text stays empty; chunks of one line
or of white space only stay; a document that loses every chunk keeps an empty
text; rows with the same doc_id and text are one document (both keep or lose the
same); rows without an id come last in the order; other columns pass through,
``n_chars`` follows the new text where it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.llm.common import Tables

#: A chunk ends after a line whose rolling hash is divisible by this.
DIVISOR = 3
LAST = (1 << 63) - 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_ld_chunks``: for each chunk its text and number of lines, in order.

    Columns made on the way are each used more than once by the next step, so the
    optimizer keeps the steps apart and no lambda computes an array again per element.
    """
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    step = docs.withColumn("_ld_lines", lines)
    step = step.withColumn("_ld_hash", F.transform("_ld_lines", _line_hash)).withColumn("_ld_n", F.size("_ld_lines"))
    pairs = F.arrays_zip(F.slice("_ld_hash", 2, F.greatest(F.col("_ld_n") - 1, F.lit(0))).alias("this"), F.slice("_ld_hash", 1, F.greatest(F.col("_ld_n") - 1, F.lit(0))).alias("before"))
    ends = F.filter(F.transform(pairs, lambda p, i: F.when(F.pmod(p["before"] * 31 + p["this"], F.lit(DIVISOR)) == 0, i + 2)), lambda e: e.isNotNull())
    step = step.withColumn("_ld_ends", ends)
    inner = F.filter("_ld_ends", lambda e: e < F.size("_ld_lines"))
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), inner).alias("a"), F.concat(inner, F.array(F.size("_ld_lines"))).alias("b"))
    step = step.withColumn("_ld_spans", spans).withColumn("_ld_n", F.size("_ld_lines"))
    return step.withColumn("_ld_chunks", F.transform("_ld_spans", lambda s: F.struct(
        F.array_join(F.slice("_ld_lines", s["a"] + 1, s["b"] - s["a"]), "\n").alias("txt"), (s["b"] - s["a"]).alias("lines")))).drop("_ld_lines", "_ld_hash", "_ld_ends", "_ld_spans", "_ld_n")


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_ld_kid", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("_ld_h", F.xxhash64(F.col("text").cast("string")))


def repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(_kid, _h, gone): per document the numbers of the chunks to remove."""
    tables = Tables(spark, "lines")
    texts = _keys(docs.select("doc_id", "text")).drop("doc_id")
    chunks = (chunked(texts).select("_ld_kid", "_ld_h", F.posexplode("_ld_chunks").alias("i", "c"))
              .where("c.lines > 1").where(F.col("c.txt").rlike(r"\S"))
              .select("_ld_kid", "_ld_h", "i", F.xxhash64("c.txt").alias("hash")))
    chunks = tables.save(chunks)
    place = F.struct("_ld_kid", "_ld_h", "i")
    first = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first")
    later = tables.save(chunks.join(first, "hash").withColumn("is_first", place == F.col("first")).select("_ld_kid", "_ld_h", "i", "hash", "is_first").distinct())
    wanted = later.groupBy("_ld_kid", "_ld_h").agg(F.collect_list(F.struct("i", "hash", "is_first")).alias("want"))
    found = (chunked(texts.join(wanted.hint("merge"), ["_ld_kid", "_ld_h"]).dropDuplicates(["_ld_kid", "_ld_h"])).select("_ld_kid", "_ld_h", "_ld_chunks", F.inline("want"))
             .select("_ld_kid", "_ld_h", "i", "hash", "is_first", F.col("_ld_chunks")[F.col("i")]["txt"].alias("txt")))
    found = tables.save(found)
    kept = found.where("is_first").select("hash", F.col("txt").alias("kept"))
    gone = found.where("not is_first").join(kept, "hash").where("txt = kept")
    gone = tables.save(gone.groupBy("_ld_kid", "_ld_h").agg(F.collect_set("i").alias("gone")))
    tables.drop(chunks, later, found)
    return gone


def dedup(spark: SparkSession, docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; ``counts`` adds n_chunks and n_removed."""
    gone = repeated(spark, docs)
    out = chunked(_keys(docs).join(gone.withColumnRenamed("gone", "_ld_gone").hint("merge"), ["_ld_kid", "_ld_h"], "left")
                  .withColumn("_ld_gone", F.coalesce("_ld_gone", F.array().cast("array<int>"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ld_chunks") - 1), F.col("_ld_gone"))
    text = F.when(F.size("_ld_gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("_ld_chunks")[i]["txt"]), "\n"))
    out = out.withColumn("_ld_text", F.when(F.col("text").isNotNull(), text))
    replaced = {"text": F.col("_ld_text"), "n_chars": F.length("_ld_text").cast("long")}
    columns = [replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns]
    extra = [F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_chunks")).cast("long").alias("n_chunks"), F.size("_ld_gone").cast("long").alias("n_removed")] if counts else []
    return out.select(*columns, *extra)
