"""Operator 3: n-gram Jaccard join by a size-aware heavy-light split.

A document's set holds the 64-bit hashes of its distinct n-word shingles.  Equal
sets form one class (found by digest), and the join runs over classes.

*Order.*  A count-min row of fixed size over every shingle of every document
orders the shingles, rarest first; any order gives right results, a good one
gives short lists.  If two sets reach the threshold, then with ``c`` the overlap
they need, their first ``size - c + k`` shingles have ``k`` in common.

*Light sets* (size up to a boundary) enumerate the 2-subsets of that prefix:
two light sets that reach the threshold share one.  *Heavy sets* put the
shingles of the ``k = 1`` prefix into inverted lists, and so do the light sets
large enough to reach the threshold with a heavy one.  The boundary is the size
at which the written rows plus the expected scan of lists cost least, from the
histogram of set sizes.

*Links.*  A pair is compared only where its bucket's shingles may be the first it
has in common: what follows them must leave room for the overlap it needs.  In
each bucket (one subset or one list) every member is compared with one pivot,
the member with the most room; verified links give components.  Then, in
buckets that still hold several components, all remaining pairs of different
components are compared.  So every pair that could join two components has been
compared, while a group of near copies costs rows in proportion to its size.
Postings are dealt once, by bucket, and no table of buckets is built beside them.

*Comparison.*  Every set has an odd sketch: for each of as many bits as it has
shingles, whether an odd number of them falls there.  Two sets differ by at least
the bits in which their sketches differ, so a pair whose sketches differ too much
cannot reach the threshold.  Buckets grow with the table, and with them the pairs
that share a bucket by chance; the sketches refuse these, and whole texts are
fetched only for the pairs that are left.

Defined cases: null, empty or wordless text -> empty set, linked with nothing;
fewer words than ``n`` -> the whole sequence is the one shingle; rows sharing a
doc_id are one node; rows without a doc_id join classes but never name one
(component null when no other member has an id); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsignal.llm.common import Tables, blocks, connected_components, mix64

#: Counters of the sketch that orders shingles: fixed, whatever the data (summed as 256 slices).
SKETCH_BITS = 20
SLICE = 1 << (SKETCH_BITS - 8)
#: Set sizes are counted exactly up to this, then by powers of 2 ** (1/8).
EXACT_SIZES = 512
ONE = np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text): words between ASCII white space, A-Z lower-cased."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    ids = coded.indices.to_numpy(zero_copy_only=False)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.append(0, np.cumsum(real))
    count = np.diff(ends[words.offsets.to_numpy() - words.offsets[0].as_py()])
    return (table[ids] if len(table) else np.zeros(0, np.uint64))[real], count


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, count = word_hashes(texts)
    factor = mix64(np.arange(1, n + 1)) | ONE
    mixed = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        mixed += words[j:len(words) - n + 1 + j] * factor[j]
    mixed = mix64(mixed)
    at = 0
    for c in count.tolist():
        if c >= n:
            yield np.unique(mixed[at:at + c - n + 1])
        elif c:
            yield mix64((words[at:at + c] * factor[:c]).sum(dtype=np.uint64, keepdims=True) + mix64(np.array([1 << 20 | c])))
        else:
            yield np.zeros(0, np.uint64)
        at += c


def needed(n: int | np.ndarray, num: int, den: int):
    """Least overlap of a set of size n with any set that reaches num / den."""
    smallest = -(-num * n // den)
    return -(-num * (n + smallest) // (num + den))


def bin_of(n: np.ndarray) -> np.ndarray:
    return np.where(n <= EXACT_SIZES, n, EXACT_SIZES + np.floor(8 * np.log2(np.maximum(n, 1) / EXACT_SIZES)).astype(np.int64))


def size_of(b: np.ndarray) -> np.ndarray:
    return np.where(b <= EXACT_SIZES, b, EXACT_SIZES * 2.0 ** ((b - EXACT_SIZES) / 8)).astype(np.int64)


def odd_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of hashes at each bit, for a power of two bits, 64 or as many as there are hashes at least."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound, by their odd sketches, of the number of elements that only one of two sets holds."""
    x, y = sorted((x, y), key=len)
    small, large, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):  # halves laid on each other: the sketch of half as many bits
        bits //= 2
        large = (large >> bits) ^ (large & ((1 << bits) - 1))
    return (small ^ large).bit_count()


def _texts(part: pa.RecordBatch, column: str = "text") -> pa.Array:
    return part.column(part.schema.get_field_index(column))


def shingle_order(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(one byte per counter: about 4 log2 of its count; documents per size bin), over all documents.

    Both are of fixed size; only they reach the driver.
    """
    size_slice = 1 << 8  # slice number that holds the histogram

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(SLICE, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = list(shingle_sets(_texts(part), n))
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                    sizes += np.bincount(bin_of(np.array([len(s) for s in sets])), minlength=SLICE)
        rows = [(i, r.astype(np.int32).tobytes()) for i, r in enumerate(total.reshape(-1, SLICE)) if r.any()] + [(size_slice, sizes.astype(np.int32).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(c, np.int32) if len(c) == 4 * SLICE else np.frombuffer(c, np.int64)
                sums[i] = sums.get(i, 0) + row.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect()
    total, sizes = np.zeros((1 << 8, SLICE), np.int64), np.zeros(SLICE, np.int64)
    for r in parts:
        if r["slice"] == size_slice:
            sizes = np.frombuffer(r["counts"], np.int64)
        else:
            total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.round(4 * np.log2(total.ravel() + 1)).astype(np.uint8), sizes


def boundary(levels: np.ndarray, sizes: np.ndarray, num: int, den: int) -> int:
    """Largest light size: least rows of subsets, plus rows and scanned entries of lists."""
    b = np.flatnonzero(sizes)
    n, docs = size_of(b), sizes[b]
    keep = n >= 1
    n, docs = n[keep], docs[keep]
    if not len(n):
        return 1
    count = np.sort(2.0 ** (levels / 4) - 1)
    rare = count[: max(1, int(np.searchsorted(np.cumsum(count), (1 - num / den) * count.sum())))]
    scanned = 1 + rare.mean() / max(count.mean(), 1e-9)
    subsets = docs * (p2 := n - needed(n, num, den) + 2) * (p2 - 1) / 2
    lists = docs * (p2 - 1) * (1 + scanned)
    choices = [(subsets[n <= x].sum() + lists[n * den >= num * (x + 1)].sum(), x) for x in [1, *n[n <= EXACT_SIZES].tolist()]]
    return int(min(choices)[1])


def signatures(s: np.ndarray, levels: np.ndarray, light: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of one set of sorted distinct hashes, as signed 64-bit numbers; the most that can overlap from there).

    If a bucket's shingles are the first ones, in the order, that two sets have
    in common, then their overlap is at most the smaller of the two ``room``s.
    """
    n = len(s)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    p = n - needed(n, num, den)
    prefix = s[np.argsort(key, kind="stable")[: p + 2]]
    sigs, room = [], []
    if n <= light:
        i, j = np.triu_indices(len(prefix), 1)
        sigs.append(mix64(prefix[i] * np.uint64(0x9E3779B97F4A7C15) + mix64(prefix[j])))
        room.append(n - j + 1)
    if n > light or n * den >= num * (light + 1):
        sigs.append(mix64(prefix[: p + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        room.append(n - np.arange(p + 1))
    return np.concatenate(sigs).view(np.int64), np.concatenate(room)


def _beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of the rows of ``table`` that have these ids as doc_id, named by a and b.

    ``pairs`` is a written table: its size is known when the query is planned, so where its
    ids are few, ``table`` is read where it is and only rows of pairs are dealt."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    rows = table.select("doc_id", *columns).join(ids, "doc_id", "left_semi")
    a, b = (rows.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)) for end in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", *(f"{c}_{end}" for c in columns for end in "ab"))


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` without those whose odd sketches rule out that they reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n_a, n_b, x, y = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            ok = [(num + den) * least_difference(p, q) <= (den - num) * (i + j) for i, j, p, q in zip(n_a, n_b, x, y)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _beside(pairs, sets.where("sketch is not null"), ["n", "sketch"]).mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a written table, whose sets reach the threshold, judged on whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in blocks(batch, "text_a"):
                ok = []
                left, right = _texts(part, "text_a"), _texts(part, "text_b")
                for x, y, i in zip(part.column(part.schema.get_field_index("a")).to_pylist(), shingle_sets(left, n), range(part.num_rows)):
                    b_id = part.column(part.schema.get_field_index("b"))[i].as_py()
                    if b_id not in known:
                        if len(known) > 64:
                            known.clear()
                        known[b_id] = next(shingle_sets(right.slice(i, 1), n))
                    z = known[b_id]
                    both = len(np.intersect1d(y, z, assume_unique=True))
                    ok.append(den * both >= num * (len(y) + len(z) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _beside(pairs, docs, ["text"]).mapInArrow(run, "a long, b long")


def _grouped(postings: DataFrame) -> DataFrame:
    """The rows of every bucket but its pivot's, with the pivot's, and whether the bucket holds others beside the two (``more``).

    The pivot has the most room: of near copies, the one with the fewest shingles of its own."""
    draw = F.shiftleft(-F.col("room"), 32) + F.pmod(F.xxhash64("node", "sig"), F.lit(1 << 32))
    w = Window.partitionBy("sig").orderBy("draw", "node", "n")
    first = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (postings.withColumn("draw", draw)
            .select("sig", "node", "n", "room", *(F.first(c).over(first).alias(f"pivot{x}") for c, x in (("node", ""), ("n", "_n"), ("room", "_room"))),
                    F.row_number().over(w).alias("place"), F.lead("node").over(w).alias("next"))
            .where("place > 1 and (node <> pivot or n <> pivot_n)")
            .withColumn("more", F.expr("place > 2 or next is not null")).drop("place", "next"))


def components(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    tables = Tables(spark, "join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels, sizes = shingle_order(docs, n)
    light = boundary(levels, sizes, num, den)
    sent = spark.sparkContext.broadcast(levels)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            for part in blocks(batch, "text"):
                size, digest, sigs, room, sketch = [], [], [], [], []
                for s in shingle_sets(_texts(part), n):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    own = signatures(s, order, light, num, den)
                    sigs.append(own[0])
                    room.append(own[1])
                    sketch.append(odd_sketch(s) if len(own[0]) else None)
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in sigs])).astype(np.int32))
                sigs, room = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (sigs, room))
                yield pa.RecordBatch.from_arrays([_texts(part, "doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), sigs, room,
                                                  pa.array(sketch, pa.binary())], names=["doc_id", "n", "digest", "sigs", "room", "sketch"])

    sets = tables.save(docs.mapInArrow(describe, "doc_id long, n long, digest binary, sigs array<long>, room array<long>, sketch binary"))
    classes = tables.save(sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node")))
    # one posting per class and bucket: only the row that names the class has postings
    postings = (sets.where("digest is not null and size(sigs) > 0").select("doc_id", "n", "digest", "sigs", "room")
                .join(classes.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"], "left_semi")
                .select(F.col("doc_id").alias("node"), "n", F.inline(F.arrays_zip(F.col("sigs").alias("sig"), F.col("room").alias("room")))))

    def close(x: str, y: str, rx: str, ry: str) -> str:
        return f"{num} * greatest({x}, {y}) <= {den} * least({x}, {y}) and {num + den} * least({rx}, {ry}) >= {num} * ({x} + {y})"

    def linked(pairs: DataFrame) -> DataFrame:
        near = tables.save(pairs.distinct())
        possible = tables.save(_possible(near, sets, num, den))
        out = tables.save(_verify(possible, docs, n, num, den))
        tables.drop(near, possible)
        return out

    members = tables.save(_grouped(postings).withColumn("star", F.expr(f"node <> pivot and {close('n', 'pivot_n', 'room', 'pivot_room')}")).where("star or more"))
    links = linked(members.where("star").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
    first = connected_components(tables, links)
    placed = members.where("more").select("sig", "node", "n", "room").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bucket = Window.partitionBy("sig")
    rest = (placed.withColumn("lo", F.min("component").over(bucket)).withColumn("hi", F.max("component").over(bucket)).where("lo < hi")
            .select("sig", "node", "n", "room", "component").distinct())
    other = rest.select("sig", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("room").alias("broom"), F.col("component").alias("bc"))
    found = linked(rest.join(other, "sig").where("node < b and component <> bc").where(close("n", "bn", "room", "broom")).select(F.col("node").alias("a"), "b"))
    nodes = connected_components(tables, links.union(found))
    tables.drop(links, found, members)
    named = classes.join(nodes, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (sets.select("doc_id", "n", "digest").join(named, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but the document that names its component (rows without an id stay)."""
    # written first: its size is then known when the join is planned, and whole texts are dealt only where it is large
    gone = Tables(spark, "join-gone").save(components(spark, docs, n, num, den).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
