"""Clusters against plain Python integers, lossless dictionaries, and the defined cases."""

import hashlib
import math
import random

import numpy as np

from jobsignal.llm import centroids as X


def plain(rows, k=16, rounds=3):
    kept = [(i, [max(-X.LARGEST, min(X.LARGEST, math.floor(64 * x))) for x in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    text = lambda i: "" if i is None else str(i)
    c = [v for _, v in sorted((hashlib.sha256(f"1:{text(i)}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(g) for x in zip(*g)] if g else m for g, m in zip(groups, c)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in last)
    return sorted(((i, n, d, sum(x for _, m, x in last if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in last), key=str)


def got(spark, rows, schema="vec_id long, embedding array<double>, cluster int, distance string", extra=(1, "x")):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)
    return sorted((tuple(r) for r in X.cluster(spark, df).collect()), key=str)


def vectors(n, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.5) for _ in range(64)] for _ in range(5)]
    return [(i, [x + r.gauss(0, 0.1) for x in centres[i % 5]]) for i in range(n)]


def test_equals_plain_python(spark):
    rows = vectors(120)
    rows += [(200, None), (201, [0.5] * 63), (202, [None] * 64), (203, [math.nan] * 64), (204, [math.inf] + [0.0] * 63), (None, rows[3][1]), (None, rows[4][1]),
             (5, rows[9][1]), (7, rows[7][1]), (205, [0.0] * 64), (206, [-1e-9] * 64)]
    assert got(spark, rows) == plain(rows)


def test_repeated_vectors_leave_empty_centroids_and_ties(spark):
    rows = [(i, [0.25] * 64) for i in range(40)] + [(100, [0.5] * 64)]
    assert got(spark, rows) == plain(rows)


def test_few_or_no_vectors(spark):
    assert got(spark, vectors(3)) == plain(vectors(3))
    assert got(spark, [(1, None), (2, [1.0])]) == []
    assert got(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [1e300, -1e300] * 32), (4, [2.0 ** 20 + 0.01] * 64)]
    assert got(spark, rows) == plain(rows)


def test_dictionaries_are_lossless():
    r = np.random.default_rng(2)
    for v in (r.integers(-9, 9, (500, 64)), r.integers(-X.LARGEST, X.LARGEST + 1, (50, 64)), np.zeros((4, 64), np.int64)):
        blocks = X.encode(v)
        assert (X.decode(X.unpack(X.pack(blocks), 64)) == v).all()
        assert all(len(np.unique(e, axis=0)) == len(e) for e, _ in blocks)
        c = r.integers(-9, 9, (4, 64))
        n, d = X.nearest(blocks, c)
        direct = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (n == direct.argmin(1)).all() and (d == direct.min(1)).all()
        assert (X.cluster_sums(blocks, n, 4) == np.array([v[n == i].sum(0) for i in range(4)])).all()
