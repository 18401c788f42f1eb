"""Operator 9: removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or earlier in the same document); all are judged on the input.

No task can hold a suffix array of everything, so equal strings are first
brought together.  Each string has an anchor, the ``GRAM`` bytes in it with the
least hash, and consecutive strings of one anchor form a segment; equal strings
have equal anchors at equal places.

1. Per anchor, equal segments are found by digest, within each block of text
   before the shuffle (so a passage in very many documents sends a few rows) and
   then over all blocks in sorted order, row by row: all but the first go whole.
2. Where one anchor has different segments, their first occurrences are compared
   inside: two strings that are equal agree in ``REACH`` bytes before or after the
   anchor, which makes two narrow keys per segment.  Per key the segments' bytes
   are joined, and in their suffix array, cut at ``LENGTH`` bytes, the previous and
   the next smaller position in suffix order say whether a string stands earlier.
3. Anchors whose different segments hold more than ``BLOCK`` bytes go another way,
   so that no task collects them: each of their strings becomes a narrow row of
   anchor, digest and place, and those behind the least place of their (anchor,
   digest), a partial aggregate, are repeats.

Defined cases: null text -> no bytes; texts shorter than ``LENGTH`` lose nothing;
strings never cross documents; rows with the same doc_id and text are one
document, other rows that share a doc_id stand in the order of a hash of the text;
rows without an id come last in the order; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.llm.common import Tables, blocks, mix64
from jobsignal.llm.suffix import argsort, suffix_ranks

LENGTH = 100
GRAM = 32
REACH = (LENGTH - GRAM) // 2
#: Bytes of text whose anchors are found at once, and of segments in one suffix array.
BLOCK = 2 << 20
LAST = (1 << 63) - 1
BYTE = mix64(np.arange(1, 257))
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a gram's hash that hold its place in a slice, and the strings of a slice.
PLACE = np.uint64((1 << 24) - 1)
SLICE = 1 << 16


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, inverse))


class Hashes:
    """Hash of any span of a byte string."""

    def __init__(self, raw: np.ndarray):
        n = 1 << max(20, len(raw).bit_length())
        power, self.inverse = _powers(n)
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * power[: len(raw)], dtype=np.uint64))

    def grams(self, a: int, n: int) -> np.ndarray:
        """Hashes of the n grams from place a on."""
        return mix64((self.sums[a + GRAM:a + GRAM + n] - self.sums[a:a + n]) * self.inverse[a:a + n] + np.uint64(GRAM))

    def spans(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((self.sums[e] - self.sums[a]) * self.inverse[a] + (e - a).astype(np.uint64))


def segments(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """(text, first byte, end, anchor) of each segment of the joined texts, and their hashes."""
    hashes = Hashes(raw)
    n = len(raw) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, hashes
    anchor = np.empty(n, np.int64)
    reach = min(SLICE, int(PLACE) + 1 - LENGTH)  # places inside a slice never wrap, and its arrays stay in the cache
    for s in range(0, n, reach):
        m = min(reach, n - s)
        low = (hashes.grams(s, m + LENGTH - GRAM) & ~PLACE) | np.arange(m + LENGTH - GRAM, dtype=np.uint64)
        width, want = 1, LENGTH - GRAM + 1
        while width < want:
            step = min(width, want - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        anchor[s:s + m] = (low & PLACE).astype(np.int64) + s
    text = np.repeat(np.arange(len(size)), size)
    whole = text[:n] == text[LENGTH - 1:]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:n] != text[: n - 1]) | ~whole[:-1]]
    first = np.flatnonzero(new & whole)
    edge = np.append(np.flatnonzero(new), n)
    last = edge[np.searchsorted(edge, first, side="right")] - 1
    last = np.where(whole[last], last, np.maximum.accumulate(np.where(whole, np.arange(n), -1))[last])
    return text[first], first, last + LENGTH, anchor[first], hashes


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("kid"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def _column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def _raw(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = _column(part, "text")
    return np.frombuffer(b"".join(texts.to_pylist()), np.uint8), pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


SEGMENT = "anchor long, digest long, kid long, h long, a int, e int, dup boolean"
NAMES = ["anchor", "digest", "kid", "h", "a", "e", "dup"]


def _rows(anchor, digest, kid, h, a, e, dup) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((anchor, digest, kid, h, a, e, dup), kinds)], names=NAMES)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each block; of equal ones the first stays in the race, the others are repeats already."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            raw, size = _raw(part)
            text, a, e, anchor, hashes = segments(raw, size)
            if not len(a):
                continue
            kid, h = (_column(part, c).to_numpy(zero_copy_only=False)[text] for c in ("kid", "h"))
            key, digest = hashes.spans(anchor, anchor + GRAM), hashes.spans(a, e)
            at = a - (np.cumsum(size) - size)[text]
            order = np.lexsort((at, h, kid, digest))
            again = np.r_[False, np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (kid, h, at)])]  # the same document in another row
            order = order[~again]
            same = np.r_[False, (digest[order][1:] == digest[order][:-1]) & (key[order][1:] == key[order][:-1])]
            yield _rows(key.view(np.int64)[order], digest.view(np.int64)[order], kid[order], h[order], at[order], (at + e - a)[order], same)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (anchor, digest, place): repeats, and first occurrences of anchors with several digests.

    Rows already known as repeats pass through.
    Keeps one row between batches, however many rows an anchor has.
    """
    held = None  # the last first occurrence, not yet known to share its anchor
    before = last = (None,) * 5
    for batch in batches:
        known = batch.column(6)
        if pc.any(known).as_py():
            yield batch.filter(known)
            batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        again = np.logical_and.reduce([np.r_[c[0] == b, c[1:] == c[:-1]] for c, b in zip(cols, before)])  # the same document in another row
        before = tuple(c[-1] for c in cols[:5])
        if again.all():
            continue
        key, digest = cols[0], cols[1]
        same_key = np.r_[key[0] == last[0], key[1:] == key[:-1]][~again]
        dup = np.r_[digest[0] == last[1], digest[1:] == digest[:-1]][~again] & same_key
        last = before
        cols = [c[~again] for c in cols]
        if dup.any():
            yield _rows(*(c[dup] for c in cols), np.ones(int(dup.sum()), bool))
        lead = [c[~dup] for c in cols]
        mixed_before = same_key[~dup]
        if held is not None:
            if len(mixed_before) and mixed_before[0]:
                held = (held[0], True)
            lead = [np.r_[[x], c] for x, c in zip(held[0], lead)]
            mixed_before = np.r_[held[1], mixed_before]
        mixed = mixed_before | np.r_[lead[0][1:] == lead[0][:-1], False]
        held = ([c[-1] for c in lead], bool(mixed[-1]))
        out = mixed[:-1]
        if out.any():
            yield _rows(*(c[:-1][out] for c in lead), np.zeros(int(out.sum()), bool))
    if held is not None and held[1]:
        yield _rows(*([x] for x in held[0]), [False])


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 without."""
    prev = np.arange(len(values)) - 1
    todo = np.flatnonzero((prev >= 0) & (values[prev] >= values))
    while len(todo):
        prev[todo] = prev[prev[todo]]
        todo = todo[(prev[todo] >= 0) & (values[prev[todo]] >= values[todo])]
    return prev


def earlier(codes: np.ndarray, place: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of ``starts`` have a string of ``length`` symbols that also starts at a start of smaller ``place``.

    In suffix order the longest previous factor is reached by the previous or the
    next smaller place; it is long enough if that neighbour has the same rank.
    """
    rank = suffix_ranks(codes, length)[starts]
    order = np.lexsort((place, rank))
    r, p = rank[order], place[order]
    before = previous_smaller(p)
    after = len(p) - 1 - previous_smaller(p[::-1])[::-1]
    hit = ((before >= 0) & (r[before] == r)) | ((after < len(p)) & (r[np.minimum(after, len(p) - 1)] == r))
    out = np.zeros(len(starts), bool)
    out[order] = hit
    return out


SPAN = "kid long, h long, a int, e int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments sorted by key: the spans of repeated strings inside them; whole keys go together."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = sorted({r[1:] for r in rows})
        if len(rows) < 2:
            return None
        size = np.array([len(r[3]) for r in rows], np.int64)
        joined = np.frombuffer(b"".join(r[3] + b"\0" for r in rows), np.uint8).astype(np.int64) + 1
        begin = np.cumsum(size + 1) - size - 1
        joined[begin + size] = 0  # ends a segment, unlike any byte
        n = size - LENGTH + 1
        own = np.repeat(np.arange(len(rows)), n)
        off = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        docs = {d: i for i, d in enumerate(sorted({r[:2] for r in rows}))}
        at = np.array([r[2] for r in rows])[own] + off
        place = (np.array([docs[r[:2]] for r in rows])[own] << 40) | at
        hit = np.flatnonzero(earlier(joined, place, begin[own] + off))
        if not len(hit):
            return None
        new = np.r_[True, (np.diff(hit) != 1) | (own[hit][1:] != own[hit][:-1])]
        first, last = hit[new], hit[np.r_[new[1:], True]]
        kid, h = ([rows[i][c] for i in own[first]] for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(kid, pa.int64()), pa.array(h, pa.int64()), pa.array(at[first], pa.int32()), pa.array(at[last] + LENGTH, pa.int32())], names=["kid", "h", "a", "e"])

    rows: list[tuple] = []
    group: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if group and row[0] != group[0][0]:
                if len(group) > 1:  # a key of one segment has nothing to compare
                    rows += group
                    held += sum(len(r[4]) for r in group)
                    if held > BLOCK:
                        if (out := solve(rows)) is not None:
                            yield out
                        rows, held = [], 0
                group = []
            group.append(row)
    if len(group) > 1:
        rows += group
    if rows and (out := solve(rows)) is not None:
        yield out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Narrow keys and bytes of the wanted segments of each document."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            out: list[tuple] = []
            for text, kid, h, wanted in zip(*(_column(part, c).to_pylist() for c in ("text", "kid", "h", "wanted"))):
                raw = np.frombuffer(text, np.uint8)
                a, e = (np.array([w[k] for w in wanted], np.int64) for k in ("a", "e"))
                _, first, _, anchor, hashes = segments(raw, np.array([len(raw)]))
                at = anchor[np.searchsorted(first, a)]
                for sel, x, y in ((e - at - GRAM >= REACH, at, at + GRAM + REACH), (at - a >= REACH, at - REACH, at + GRAM)):
                    keys = hashes.spans(x[sel], y[sel]).view(np.int64).tolist()
                    out += [(k, kid, h, int(i), text[i:j]) for k, i, j in zip(keys, a[sel], e[sel])]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "kid", "h", "a", "bytes"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, digest and place of each string of the wanted segments of each document."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            for text, kid, h, wanted in zip(*(_column(part, c).to_pylist() for c in ("text", "kid", "h", "wanted"))):
                raw = np.frombuffer(text, np.uint8)
                a, e = (np.array([w[k] for w in wanted], np.int64) for k in ("a", "e"))
                _, first, _, anchor, hashes = segments(raw, np.array([len(raw)]))
                n = e - a - LENGTH + 1
                at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                mark = np.repeat(anchor[np.searchsorted(first, a)], n)
                cols = (hashes.spans(mark, mark + GRAM).view(np.int64), hashes.spans(at, at + LENGTH).view(np.int64), np.full(len(at), kid), np.full(len(at), h), at)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "digest", "kid", "h", "a"])


def candidates(tables: Tables, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Spans that go whole, keyed bytes to compare (at most ``BLOCK`` per key), and strings of anchors with more than that."""
    texts = docs.select("kid", "h", "text")
    # one shuffle and no table of all segments: known repeats only pass through, dealt evenly by their place
    deal = F.when(F.col("dup"), F.xxhash64("kid", "h", "a")).otherwise(F.col("anchor"))
    race = texts.mapInArrow(_find, SEGMENT).repartition(deal).sortWithinPartitions("dup", "anchor", "digest", "kid", "h", "a")
    firsts = tables.save(race.mapInArrow(_first, SEGMENT))
    whole = firsts.where("dup").select("kid", "h", "a", "e")
    mixed = firsts.where("not dup")
    # the segments of a key have one anchor, so a key holds no more bytes than its anchor
    large = tables.save(mixed.groupBy("anchor").agg(F.sum(F.col("e") - F.col("a")).alias("n")).where(F.col("n") > BLOCK).select("anchor"))
    some = large.limit(1).count() > 0

    def wanted(segments: DataFrame) -> DataFrame:
        return texts.join(segments.groupBy("kid", "h").agg(F.collect_list(F.struct("a", "e")).alias("wanted")), ["kid", "h"])

    small = mixed.join(large, "anchor", "left_anti") if some else mixed
    cut = wanted(small).mapInArrow(_cut, "key long, kid long, h long, a int, bytes binary").distinct()
    if not some:
        return whole, cut, None
    return whole, cut, wanted(mixed.join(large, "anchor", "left_semi")).mapInArrow(_strings, "anchor long, digest long, kid long, h long, a int")


def repeated_spans(spark: SparkSession, tables: Tables, docs: DataFrame) -> DataFrame:
    """(kid, h, a, e): spans of bytes to remove; they overlap, and together cover exactly what goes."""
    whole, cut, strings = candidates(tables, docs)
    out = whole.union(cut.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, SPAN))
    if strings is None:
        return out
    strings, place = tables.save(strings), F.struct("kid", "h", "a")
    first = (strings.groupBy("anchor", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first <> last").select("anchor", "digest", "first"))
    later = strings.join(first, ["anchor", "digest"]).where(place != F.col("first"))
    return out.union(later.select("kid", "h", "a", (F.col("a") + LENGTH).alias("e")))


def dedup(spark: SparkSession, docs: DataFrame, text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``text`` adds the remaining bytes (``kept``)."""
    tables = Tables(spark, "suffix")
    docs = _keyed(docs)
    spans = repeated_spans(spark, tables, docs)
    per = tables.save(spans.groupBy("kid", "h").agg(F.collect_set(F.struct("a", "e")).alias("spans")))
    kind = dict(docs.dtypes)["doc_id"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                n, removed, runs, digest, left = [], [], [], [], []
                for raw, own in zip(_column(part, "text").to_pylist(), _column(part, "spans").to_pylist()):
                    kept, end, count = [], 0, 0
                    for s in sorted((s["a"], s["e"]) for s in own or []):
                        if s[0] > end or not count:
                            kept.append(raw[end:s[0]])
                            count += 1
                        end = max(end, s[1])
                    kept.append(raw[end:])
                    rest = b"".join(kept)
                    n.append(len(raw))
                    removed.append(len(raw) - len(rest))
                    runs.append(count)
                    digest.append(hashlib.sha256(rest).hexdigest())
                    left.append(rest if text else None)
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(digest), pa.array(left, pa.binary())],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = docs.join(per, ["kid", "h"], "left").mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if text else out.drop("kept")
