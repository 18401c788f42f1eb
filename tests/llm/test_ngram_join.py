"""Components and set sizes equal brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from jobsignal.llm import ngram_join as N


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two three")]
    hot = "the same line in very many texts of this table".split()
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([4, 12, 30, 60, 200]))]
        if r.random() < 0.5:
            base = hot + base
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(t))
                t[k:k + 1] = r.choice([[], [r.choice(vocab)], [t[k], r.choice(vocab)]])
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,num,light", [(3, 90, None), (5, 80, None), (3, 90, 0), (2, 70, 100), (5, 80, 60)])
def test_equals_brute_force(spark, monkeypatch, n, num, light):
    if light is not None:
        monkeypatch.setattr(N, "boundary", lambda *a: light)
    rows = corpus(n * 100 + num)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(spark, docs, n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_prefixes_share_enough():
    r = np.random.default_rng(5)
    levels = r.integers(0, 9, 1 << N.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(2, 80))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 1 << 62, int(r.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) > 1 and len(b) > 1 and 100 * both >= 80 * (len(a) + len(b) - both):
            for light in (0, 30, 100):
                x, y = (dict(zip(*map(np.ndarray.tolist, N.signatures(v, levels, light, 80, 100)))) for v in (a, b))
                assert any(180 * min(x[k], y[k]) >= 80 * (len(a) + len(b)) for k in x.keys() & y.keys())


def test_missing_and_repeated_ids(spark):
    t = " ".join(f"x{i}" for i in range(40))
    rows = [(None, t, "a"), (9, t, "b"), (4, t + " y", "c"), (4, t + " y", "c"), (None, "alone here now", "d"), (7, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted(((r.doc_id, r.component_id) for r in N.components(spark, docs, 3, 90, 100).collect()), key=repr)
    assert got == sorted([(None, 4), (9, 4), (4, 4), (4, 4), (None, None), (7, 7)], key=repr)
    kept = N.keep_one(spark, docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(["None", "None", "4", "4", "7"])


def test_empty_table(spark):
    assert N.components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_copies_do_not_deal_every_text(spark):
    """The texts that are compared, and those that stay, are found by a known small table: no shuffle of all texts."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(60)] +
                                 [(100 + i, " ".join(f"w{i}x{j}" for j in range(29)) + " other") for i in range(5)], "doc_id long, text string")
    kept = N.keep_one(spark, docs, 5, 80, 100)
    static = kept._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in static and "SortMergeJoin" not in static
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_sketches_bound_the_difference():
    """Sketches never claim more than the sets differ by, also of unlike sizes; unrelated sets are told apart."""
    r = np.random.default_rng(7)
    for n in (1, 2, 60, 64, 65, 127, 128, 129, 500, 1030, 5000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for b in (a, a[: n - n // 20], np.append(a, r.integers(0, 1 << 63, n // 10 + 1).astype(np.uint64)), r.integers(0, 1 << 63, n + n // 9).astype(np.uint64)):
            low = N.least_difference(N.odd_sketch(a), N.odd_sketch(np.unique(b)))
            assert low == N.least_difference(N.odd_sketch(np.unique(b)), N.odd_sketch(a))
            assert low <= len(np.setxor1d(a, b))
            if n > 50 and not len(np.intersect1d(a, b)):
                assert 180 * low > 20 * (len(a) + len(b))


def test_texts_of_chance_pairs_are_not_fetched(spark, monkeypatch):
    """Sets that share a bucket but half of their shingles at most are refused before their texts are compared."""
    passage = " ".join(f"p{j}" for j in range(30))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    compared, verify = [], N._verify

    def counted(pairs, *rest):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return verify(pairs, *rest)

    monkeypatch.setattr(N, "_verify", counted)
    monkeypatch.setattr(N, "shingle_order", lambda docs, n: (np.zeros(1 << N.SKETCH_BITS, np.uint8), np.bincount([58, 59], minlength=N.SLICE)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(spark, docs, 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert sorted(set(compared)) == [(0, 100), (1, 101), (2, 102)]


def test_postings_are_dealt_once(spark):
    """One exchange gives every bucket's pivot and its other members; a repeated row is no member beside its pivot."""
    rows = [(1, 10, 50, 40), (1, 11, 50, 45), (1, 12, 50, 41), (2, 10, 50, 40), (2, 11, 50, 42), (3, 10, 50, 40), (4, 10, 50, 40), (4, 10, 50, 40), (5, 10, 50, 40), (5, 10, 40, 30)]
    df = N._grouped(spark.createDataFrame(rows, "sig long, node long, n long, room long").repartition(3))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((r.sig, r.node, r.n, r.room, r.pivot, r.pivot_n, r.pivot_room, r.more) for r in df.collect())
    assert got == [(1, 10, 50, 40, 11, 50, 45, True), (1, 12, 50, 41, 11, 50, 45, True), (2, 10, 50, 40, 11, 50, 42, False), (5, 10, 40, 30, 10, 50, 40, False)]
