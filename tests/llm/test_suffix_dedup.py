"""Removed bytes equal brute force over all 100-byte strings; suffix helpers; defined cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsignal.llm import suffix_dedup as S
from jobsignal.llm.suffix import suffix_array


def brute(docs, length=100):
    seen, out = set(), {}
    for i, raw in sorted(set(docs), key=lambda d: (d[0] is None, d)):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i, raw] = (len(raw), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return sorted(((i, *out[i, raw]) for i, raw in docs), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "é", "is "]) for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.choice([8, 15, 40, 120]))) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 350), (5, "ab" * 200)]
    for i in range(6, 70):
        parts = [" ".join(word() for _ in range(r.choice([0, 3, 30, 100]))) for _ in range(r.randint(1, 3))]
        parts += [r.choice(passages) for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        t = "".join(parts)
        if r.random() < 0.3 and len(t) > 10:
            k = r.randrange(len(t))
            t = t[:k] + r.choice(["", "#", "two words"]) + t[k + 1:]
        rows.append((i, t))
    for i in range(70, 90):
        src = r.choice(rows)[1] or ""
        k = r.randrange(len(src) + 1)
        rows.append((i, src[:k] + r.choice(["", "~", "~~~ ~"]) + src[k:]))
    rows += [(None, rows[10][1]), (12, rows[12][1]), (300, rows[13][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2 << 20), (2, 3000)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kid int").repartition(3)
    got = S.dedup(spark, docs, text=True).collect()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sum(w[2] for w in want) > 3000


def test_no_key_holds_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4000)
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, long_ = noise(80), noise(180)
    rows = [(i, noise(150) + (short if i % 2 else long_) + noise(150)) for i in range(200)]
    rows += [(200 + i, rows[i][1][40:300]) for i in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, cut, strings = S.candidates(S.Tables(spark, "test"), S._keyed(docs))
    sizes = [x.n for x in cut.groupBy("key").agg(F.sum(F.length("bytes")).alias("n")).collect()]
    assert max(sizes, default=0) <= 4000 and strings.count() > 2000
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.dedup(spark, docs).collect()]
    assert sorted(got, key=repr) == brute([(i, t.encode()) for i, t in rows])


def test_earlier_by_hand():
    r = np.random.default_rng(0)
    for _ in range(20):
        codes = r.integers(1, 3, 60)
        starts = np.arange(55)
        place = r.permutation(55)
        got = S.earlier(codes, place, starts, 6)
        strings = [tuple(codes[s:s + 6]) for s in starts]
        assert got.tolist() == [any(strings[j] == strings[i] and place[j] < place[i] for j in range(55)) for i in range(55)]


def test_suffix_array_cut_at_depth():
    r = np.random.default_rng(2)
    for depth in (1, 2, 5, 16, 37):
        codes = r.integers(1, 4, 200)
        sa, rank = suffix_array(codes, depth)
        key = [tuple(codes[i:i + depth]) for i in range(200)]
        assert sa.tolist() == sorted(range(200), key=lambda i: (key[i], i))
        assert all((rank[i] == rank[j]) == (key[i] == key[j]) for i in range(0, 200, 7) for j in range(200))


def test_empty_table(spark):
    assert S.dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_do_not_depend_on_slices(monkeypatch):
    """Equal grams stand in one string across the end of a slice, and beyond the largest place that a hash can hold."""
    import numpy as np

    r = np.random.default_rng(6)
    gram = bytes(r.integers(97, 101, 32, dtype=np.uint8))
    raw = np.frombuffer(b"".join((gram + bytes(r.integers(97, 99, 9, dtype=np.uint8))) for _ in range(300)) + b"a" * 5000, np.uint8)
    size = np.array([len(raw) - 700, 700])

    def anchors():
        text, first, end, anchor, _ = S.segments(raw, size)
        return list(zip(text.tolist(), first.tolist(), end.tolist(), anchor.tolist()))

    want = anchors()
    plain = S.Hashes(raw)
    h = plain.grams(0, len(raw) - 31) & ~S.PLACE
    for _, first, end, anchor in want:
        for start in range(first, end - 99):
            assert anchor == start + int(np.argmin(h[start:start + 69]))
    monkeypatch.setattr(S, "SLICE", 150)
    assert anchors() == want


def test_repeat_behind_sixteen_mebibytes(spark):
    r = random.Random(4)
    hot = "ab" * 50  # all its grams are equal by twos, so place decides between them
    long = "".join(r.choices("cdefghijklmnop", k=(1 << 24) - 40)) + hot + "z" * 10
    docs = spark.createDataFrame([(1, "x" + hot + "y"), (2, long)], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in S.dedup(spark, docs).collect()}
    assert got == {1: (102, 0, 0), 2: (len(long), 100, 1)}
