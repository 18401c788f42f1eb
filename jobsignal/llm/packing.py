"""Operator 4: token ids packed into fixed-length sequences by best-fit decreasing.

Inside each task documents are gathered up to ``GROUP`` tokens.  Documents longer
than a sequence are split into whole sequences and a rest; the pieces, longest
first, each go to the fullest sequence that still has room, found by a segment
tree over remaining capacities.  Nothing is shuffled and no task holds more than
one group, so the number of sequences that end unfilled is bounded per group.

A row is one sequence: its ids as little-endian unsigned integers (16 bits where
the vocabulary allows), padded to full length; ``cu_seqlens``, the cumulative
lengths of its segments; ``position_ids``, which start again at 0 with every
segment; and for each segment its document and the offset inside it, by which
``unpack`` restores all documents.

Defined cases: null or empty text has no tokens and no segment; a long document
has segments in several rows; repeated rows are packed as often as they occur;
rows without an id are packed with a null document; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsignal.llm.common import blocks

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
#: Tokens that one task packs at once.
GROUP = 1 << 20
#: Words whose ids a worker remembers; beyond that it forgets all of them.
REMEMBERED = 300_000


class CapacityTree:
    """Bins by remaining capacity; finds the least capacity of at least a size."""

    def __init__(self, length: int):
        self.half = 1 << length.bit_length()
        self.count = [0] * (2 * self.half)
        self.bins: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        i = self.half + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.bins.setdefault(capacity, []).append(number)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, bin) of the fullest bin with room for ``size``, removed."""
        i = self.half + size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up until a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.half:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.half
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each bin: longest first, each into the fullest bin with room."""
    tree, bins = CapacityTree(length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            bins.append([])
            found = (length, len(bins) - 1)
        bins[found[1]].append(item)
        if found[0] > sizes[item]:
            tree.put(found[0] - sizes[item], found[1])
    return bins


class Tokens:
    """Ids of texts by a byte-level vocabulary; words between single spaces are remembered."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.odd = re.compile(r" \s|\s |^\s|\s$")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            rows = [self.encoding.encode_ordinary(w) for w in new]
            size = np.array([len(r) for r in rows], np.int64)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter((x for r in rows for x in r), np.int32, int(size.sum())))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text.  A single space between two words always begins a word's first token,
        so words may be encoded alone; texts with other spaces are encoded whole."""
        texts = pc.fill_null(texts, "")
        strings = texts.to_pylist()
        plain = np.array([not self.odd.search(t) and t != "" for t in strings], bool)
        words = pc.split_pattern(texts.filter(pa.array(plain, pa.bool_())), " ")
        count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        head = np.zeros(len(flat), bool)
        head[np.cumsum(count) - count] = True
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.unique(at[head])
        number = self._learn([" " + w for w in names] + [names[i] for i in firsts])
        which = np.where(head, len(names) + np.searchsorted(firsts, at), at)
        which = number[which] if len(which) else which
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[which] - ends + size, size)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(count))]
        quick = iter(np.split(ids, bounds[1:-1])) if len(count) else iter(())
        return [next(quick) if p else np.array(self.encoding.encode_ordinary(t), np.int32) for p, t in zip(plain, strings)]


_TOKENS: dict[int, Tokens] = {}

SCHEMA = ("pack string, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>")


def _packed(name: str, docs: list[tuple[int | None, np.ndarray]], length: int, kind: str) -> pa.RecordBatch:
    pieces = [(d, o, ids[o:o + length]) for d, ids in docs for o in range(0, len(ids), length)]
    bins = best_fit([len(p[2]) for p in pieces], length)
    ids, positions = np.zeros((len(bins), length), kind), np.zeros((len(bins), length), kind)
    ends: list[list[int]] = []
    for r, items in enumerate(bins):
        at, own = 0, [0]
        for i in items:
            n = len(pieces[i][2])
            ids[r, at:at + n], positions[r, at:at + n] = pieces[i][2], np.arange(n)
            at += n
            own.append(at)
        ends.append(own)
    return pa.RecordBatch.from_arrays([
        pa.array([f"{name}-{r}" for r in range(len(bins))]), pa.array([e[-1] for e in ends], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()),
        pa.array([x.tobytes() for x in positions], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array([[pieces[i][0] for i in b] for b in bins], pa.list_(pa.int64())),
        pa.array([[pieces[i][1] for i in b] for b in bins], pa.list_(pa.int64()))], names=["pack", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "offsets"])


def pack(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS, pattern: str | None = None, group: int = GROUP) -> DataFrame:
    """Packed sequences of the ids of ``text``; ``pack`` names partition, group and row of a sequence."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # the split pattern that belongs to the vocabulary file
    with open(ranks, "rb") as f:
        raw = f.read()
    kind = "<u2" if raw.count(b"\n") + 1 <= 1 << 16 and length <= 1 << 16 else "<u4"
    sent = docs.sparkSession.sparkContext.broadcast((raw, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, split = sent.value
        key = hash((raw, split))
        if key not in _TOKENS:
            _TOKENS[key] = Tokens(raw, split)
        part, number, held, waiting = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for block in blocks(batch, "text"):
                for d, ids in zip(block.column(0).to_pylist(), _TOKENS[key].encode(block.column(1))):
                    if len(ids):
                        waiting.append((d, ids))
                        held += len(ids)
                    if held >= group:
                        yield _packed(f"{part}-{number}", waiting, length, kind)
                        number, held, waiting = number + 1, 0, []
        if waiting:
            yield _packed(f"{part}-{number}", waiting, length, kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet with binary id matrices (one matrix row per sequence)."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """One row per segment: doc_id, offset, ids (binary); a document's segments by offset are its ids."""
    return (packed.select("pack", "ids", F.posexplode("doc_ids").alias("k", "doc_id"), "cu_seqlens", "offsets")
            .select("pack", "doc_id", F.col("offsets")[F.col("k")].alias("offset"),
                    F.expr(f"substring(ids, cu_seqlens[k] * {width} + 1, (cu_seqlens[k + 1] - cu_seqlens[k]) * {width})").alias("ids")))
