"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

Per block of texts the chunks not met before are concatenated, the suffix array
of that string is built (cut at the longest piece), every piece of the
vocabulary is found in it by binary search, and the occurrence ranges give the
edges of a segmentation lattice, ordered by position.  Relaxing the edges gives
the ids:

* ``bpe`` models: edges are taken in merge order (best score first, leftmost
  among equals, as SentencePiece does), for all chunks of the block at once;
* ``unigram`` models: the best path by summed scores.

A chunk is a run of word-start marks and what follows it: no piece of a
vocabulary with that property crosses a chunk's start, which is verified on
loading; if one does, a whole text is one chunk.

Defined cases: null text -> null ids and 0 tokens; empty text -> empty ids;
characters the vocabulary lacks -> byte pieces, or the unknown id where the
model has none; repeated rows -> equal results; other columns pass through, and
existing columns called ``ids`` or ``n_tokens`` are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsignal.llm.common import blocks
from jobsignal.llm.suffix import argsort, suffix_array

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks whose ids a worker remembers; beyond that it forgets all of them.
REMEMBERED = 150_000
#: Bytes of text that are encoded at once.
BLOCK = 2 << 20
#: Chunks up to this length are relaxed together, longer ones each by a heap.
TOGETHER = 48
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces with scores: ``pieces`` maps text to (id, score), ``byte_ids`` has 256 ids or is empty."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unk: int = 0, prefix: bool = True,
                 kind: str = "bpe", controls: frozenset[int] = frozenset()):
        self.kind, self.unk, self.prefix, self.byte_ids, self.controls = kind, unk, prefix, byte_ids, controls
        self.single = {p: i for p, (i, _) in pieces.items() if len(p) == 1}
        self.score_of = {p: s for p, (_, s) in pieces.items()}
        multi = sorted(p for p in pieces if len(p) > 1)
        self.longest = max([2, *map(len, multi)])
        self.codes = np.zeros((len(multi), self.longest), np.int64)
        for k, p in enumerate(multi):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.length = np.array([len(p) for p in multi], np.int64)
        self.ids = np.array([pieces[p][0] for p in multi], np.int64)
        self.scores = np.array([pieces[p][1] for p in multi], np.float64)
        self.rank = np.unique(-self.scores, return_inverse=True)[1].astype(np.int32)
        self.by_word = not any(MARK in p.lstrip(MARK) for p in multi)
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.by_word else ".+", re.S)
        self.text_of = {i: p for p, (i, _) in pieces.items()}
        self.char_ids = np.full(0x110000, -1, np.int32)
        self.char_ids[[ord(c) for c in self.single]] = list(self.single.values())

    @classmethod
    def load(cls, model: bytes, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(t.vocab_size())
        byte_ids = [i for i in ids if t.is_byte(i)]
        control = frozenset(i for i in ids if t.is_control(i))
        pieces = {t.id_to_piece(i): (i, t.get_score(i)) for i in ids
                  if not (t.is_byte(i) or t.is_control(i) or t.is_unknown(i) or t.is_unused(i))}
        shown = t.normalize(" a  b")
        if shown not in (f"{MARK}{MARK}a{MARK}{MARK}b", f"{MARK}a{MARK}{MARK}b"):
            raise ValueError("the model's normaliser changes more than spaces")
        return cls(pieces, byte_ids, t.unk_id(), shown.startswith(MARK * 2), kind, control)

    def normalise(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    # -- the lattice ------------------------------------------------------

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of piece) of every occurrence of every longer piece, by position.

        Characters are numbered among those of the text, so that one number holds several of
        them and a step of the binary search compares one number; a piece is searched by its
        first number among all suffixes, then by its next one within the range found.
        """
        n = len(codes)
        if not n or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbol = np.zeros(0x110000, np.int64)
        symbol[codes] = 1
        symbol = np.where(symbol, np.cumsum(symbol), 0)
        text = np.concatenate([symbol[codes], np.zeros(2 * self.longest, np.int64)])
        bits = int(symbol.max()).bit_length()
        few = max(1, min(self.longest, (63 - n.bit_length()) // bits))
        sa, _ = suffix_array(_packed(text, few, bits)[:n], self.longest, few)

        wide = min(self.longest, 63 // bits)
        words = -(-self.longest // wide)
        key = _packed(text, wide, bits)
        of_piece = np.zeros((len(self.ids), words * wide), np.int64)
        of_piece[:, : self.longest] = symbol[self.codes]
        beyond = np.arange(words * wide)[None, :] >= self.length[:, None]
        of_piece[beyond] = 0
        lowest, highest = of_piece, np.where(beyond, (1 << bits) - 1, of_piece)
        lo, hi = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        here = np.flatnonzero(((of_piece > 0) | beyond).all(1))
        for w in range(words):
            if not len(here):
                break
            low, high = (_packed(side[here, w * wide:(w + 1) * wide].ravel(), wide, bits)[::wide] for side in (lowest, highest))
            if w == 0:
                first = key[sa]
                lo[here], hi[here] = np.searchsorted(first, low, "left"), np.searchsorted(first, high, "right")
            else:
                at = sa + w * wide
                lo[here], hi[here] = (_bisect(key, at, lo[here], hi[here], low, False), _bisect(key, at, lo[here], hi[here], high, True))
            here = here[(hi[here] > lo[here]) & (self.length[here] > (w + 1) * wide)]
        low, count = lo, hi - lo
        piece = np.repeat(np.arange(len(self.ids)), count)
        at = sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        order = argsort(at)
        return at[order], piece[order]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, number of ids of each); long chunks must stand last."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        at, piece = self.edges(codes)
        if self.kind == "unigram":
            return _ragged([self._best_path(c, at, piece, int(b)) for c, b in zip(chunks, begin)])
        found = np.full((len(codes), self.longest + 1), -1, np.int32)
        found[at, self.length[piece]] = piece
        short = int(np.searchsorted(sizes > TOGETHER, True)) if (np.diff(sizes > TOGETHER) >= 0).all() else 0
        starts, ends = self._merge_short(sizes[:short], begin[:short], found)
        size = ends - starts
        parts = np.full((len(starts), 4), -1, np.int32)
        whole = size > 1
        parts[whole, 0] = self.ids[found[starts[whole], size[whole]]]
        parts[~whole, 0] = self.char_ids[codes[starts[~whole]]]
        for code in np.unique(codes[starts[(parts[:, 0] < 0)]]):
            one = self._one(chr(code))
            parts[np.ix_(~whole & (codes[starts] == code), range(len(one)))] = one
        count = (parts >= 0).sum(1)
        per = np.diff(np.append(0, np.cumsum(count))[np.searchsorted(starts, np.append(begin[:short], len(codes) + 1))])
        flat, more = _ragged([self._merge_long(c, found, int(b)) for c, b in zip(chunks[short:], begin[short:])])
        return np.append(parts[parts >= 0], flat), np.append(per, more)

    def _one(self, char: str) -> list[int]:
        if char in self.single:
            return [self.single[char]]
        if self.byte_ids:
            return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]
        return [self.unk]

    def _merge_short(self, sizes: np.ndarray, begin: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (start, end) of all short chunks: in each round every chunk makes its best merge."""
        words = np.flatnonzero(sizes <= TOGETHER)
        word = np.repeat(words, sizes[words])
        start = np.arange(len(word)) - np.repeat(np.cumsum(sizes[words]) - sizes[words], sizes[words]) + np.repeat(begin[words], sizes[words])
        end = start + 1
        rank = np.append(self.rank, NONE).astype(np.int32)

        def pair_rank(left: np.ndarray) -> np.ndarray:
            right = np.minimum(left + 1, len(word) - 1)
            size = end[right] - start[left]
            ok = (right > left) & (word[right] == word[left]) & (size <= self.longest)
            return np.where(ok, rank[found[start[left], np.where(ok, size, 0)]], NONE)

        done: list[tuple[np.ndarray, np.ndarray]] = []
        best = pair_rank(np.arange(len(word)))
        while len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(best, first)
            count = np.diff(np.r_[first, len(word)])
            live = np.repeat(lowest < NONE, count)
            if not live.all():
                done.append((start[~live], end[~live]))
                word, start, end, best = word[live], start[live], end[live], best[live]
                count, lowest = count[lowest < NONE], lowest[lowest < NONE]
                if not len(word):
                    break
            hit = np.flatnonzero(best == np.repeat(lowest, count))
            left = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]
            end[left] = end[left + 1]
            keep = np.ones(len(word), bool)
            keep[left + 1] = False
            moved = left - np.arange(len(left))
            word, start, end, best = word[keep], start[keep], end[keep], best[keep]
            best[moved] = pair_rank(moved)
            prior = moved[moved > 0] - 1
            best[prior] = pair_rank(prior)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, end = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(start)
        return start[order], end[order]

    def _merge_long(self, chunk: str, found: np.ndarray, b: int) -> list[int]:
        n = len(chunk)
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < n and (size := end[nxt[i]] - i) <= self.longest and (p := found[b + i, size]) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), i, size))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] - i != size or end[i] - i == size:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, end[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            offer(prev[i])
            offer(i)
        out: list[int] = []
        i = 0
        while i < n:
            out += [int(self.ids[found[b + i, end[i] - i]])] if end[i] - i > 1 else self._one(chunk[i])
            i = nxt[i]
        return out

    def _best_path(self, chunk: str, at: np.ndarray, piece: np.ndarray, b: int) -> list[int]:
        n = len(chunk)
        low = min([0.0, *self.score_of.values()]) - 10.0
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        lo, hi = np.searchsorted(at, [b, b + n])
        k = lo
        for i in range(n):
            one = best[i] + self.score_of.get(chunk[i], low)
            if one > best[i + 1]:
                best[i + 1], back[i + 1] = one, (i, -1)
            while k < hi and at[k] - b == i:
                p = int(piece[k])
                j = i + int(self.length[p])
                if best[i] + self.scores[p] > best[j]:
                    best[j], back[j] = best[i] + self.scores[p], (i, p)
                k += 1
        out: list[list[int]] = []
        i = n
        while i:
            i, p = (prior := back[i])
            out.append([int(self.ids[p])] if prior[1] >= 0 else self._one(chunk[i]))
        return [x for part in reversed(out) for x in part]

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of ids; adjacent byte pieces are joined as UTF-8; ids of control pieces or outside the vocabulary give nothing."""
        if not hasattr(self, "_raw"):
            byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            self._raw = {i: p.replace(MARK, " ").encode() for i, p in self.text_of.items()} | byte
        text = b"".join([self._raw.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _packed(symbols: np.ndarray, wide: int, bits: int) -> np.ndarray:
    """At every place the ``wide`` symbols from there on in one number (0 past the end)."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    for k in range(wide):
        out <<= bits
        out[: max(n - k, 0)] |= symbols[k:]
    return out


def _bisect(key: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, upper: bool) -> np.ndarray:
    """Per range [lo, hi) of ``at`` the first place whose key is not below (``upper``: is above) the value."""
    lo, hi = lo.copy(), hi.copy()
    while len(k := np.flatnonzero(lo < hi)):
        mid = (lo[k] + hi[k]) >> 1
        there = key[at[mid]]
        less = there <= value[k] if upper else there < value[k]
        lo[k] = np.where(less, mid + 1, lo[k])
        hi[k] = np.where(less, hi[k], mid)
    return lo


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return np.fromiter((x for r in rows for x in r), np.int32, int(size.sum())), size


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, in a row."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


def _with_runs(which: np.ndarray, chunks: list[str], size: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words split at single spaces -> chunks: empty words, one per further space, become marks of the next word."""
    empty = next((k for k, c in enumerate(chunks) if c == MARK), -1)
    gap = which == empty
    if not gap.any():
        return which, chunks, size
    last = np.zeros(len(which), bool)
    last[np.cumsum(size) - 1] = True
    text = np.repeat(np.arange(len(size)), size)
    stays = ~gap | last
    at = np.flatnonzero(stays)
    before = np.diff(np.append(-1, at)) - 1
    odd = np.flatnonzero((before > 0) | gap[at])
    out = which[at]
    kinds, new = np.unique(before[odd] * len(chunks) + out[odd], return_inverse=True)
    out[odd] = len(chunks) + new
    chunks = chunks + [MARK * int(k // len(chunks)) + chunks[k % len(chunks)] for k in kinds]
    used = np.bincount(out, minlength=len(chunks)) > 0
    return (np.cumsum(used) - 1)[out], [chunks[k] for k in np.flatnonzero(used)], np.bincount(text[at], minlength=len(size))


def _runs(chunks: list[str], size: int) -> Iterator[list[str]]:
    """The chunks in runs of at most ``size`` characters (one chunk at least), whatever one text holds."""
    ends = np.cumsum([len(c) + 1 for c in chunks])
    a = 0
    while a < len(chunks):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield chunks[a:b]
        a = b


class Encoder:
    """Ids of texts, with the ids of recent chunks remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(chunk number of every chunk, the chunks, chunks of each text); Arrow splits texts without marks of their own at spaces."""
        n = len(texts)
        plain = np.zeros(n, bool)
        if self.v.prefix and self.v.by_word:
            odd = pc.or_(pc.match_substring(texts, MARK), pc.equal(texts, ""))
            plain = ~odd.to_numpy(zero_copy_only=False).astype(bool)
        words = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        coded = words.flatten().dictionary_encode()
        chunks = [MARK + w for w in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        which, chunks, size = _with_runs(which, chunks, size)
        count = np.zeros(n, np.int64)
        count[plain] = size
        if plain.all():
            return which, chunks, count
        rest = [self.v.chunk.findall(self.v.normalise(t)) if t else [] for t in texts.filter(pa.array(~plain)).to_pylist()]
        count[~plain] = [len(r) for r in rest]
        begin = np.zeros(n, np.int64)
        begin[plain] = np.cumsum(count[plain]) - count[plain]
        begin[~plain] = len(which) + np.cumsum(count[~plain]) - count[~plain]
        extra = [c for r in rest for c in r]
        which = np.append(which, len(chunks) + np.arange(len(extra)))
        return which[_spans(begin, count)], chunks + extra, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null texts have none."""
        texts = pc.fill_null(texts, "")
        which, chunks, count = self._chunks(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        new = sorted(set(chunks).difference(self.known), key=lambda c: len(c) > TOGETHER)
        for new in _runs(new, BLOCK // 4):
            flat, size = self.v.encode_chunks(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, flat)
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[which] if chunks else which
        size = self.size[number]
        ends = np.append(0, np.cumsum(size))
        return self.flat[_spans(self.start[number], size)], np.diff(ends[np.append(0, np.cumsum(count))])


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder_source(df: DataFrame, model: str, kind: str):
    """A function giving a worker's encoder, kept from task to task.

    The model file (about half a megabyte, whatever the data) is read on the
    driver and sent once to each worker.
    """
    with open(model, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def get() -> Encoder:
        key = (hash(sent.value), kind)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(Vocabulary.load(sent.value, kind))
        return _ENCODERS[key]

    return get


def encode(docs: DataFrame, model: str = MODEL, kind: str = "bpe", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens``; see the module for defined cases."""
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    get = encoder_source(docs, model, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for batch in batches:
            for part in blocks(batch, text, BLOCK):
                texts = part.column(part.schema.get_field_index(text))
                ids, n = enc.encode(texts)
                offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(n, pa.int64())],
                                                 names=[*keep, "ids", "n_tokens"])

    return docs.select(*keep).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL, kind: str = "bpe", ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids in column ``to``; null ids give null."""
    keep = [c for c in tokens.columns if c != to]
    schema = T.StructType([*tokens.select(*keep).schema.fields, T.StructField(to, T.StringType())])
    get = encoder_source(tokens, model, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = get().v
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = col.slice(a, 500)
                flat, off = rows.values.to_numpy(), rows.offsets.to_numpy()
                texts = [v.decode(flat[off[i]:off[i + 1]].tolist()) if rows[i].is_valid else None for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, to])

    return tokens.select(*keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """Encode, decode again and compare: doc_id, n_tokens, ids, lossless (null text: null)."""
    out = decode(encode(docs.select("doc_id", "text"), model, kind), model, kind)
    return out.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("lossless"))
