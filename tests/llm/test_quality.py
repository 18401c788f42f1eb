"""Measures against plain Python, gradients against differences, held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa

from jobsignal.llm import quality as Q


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(r.choice(["ka", "lo", "min", "té", "sur"]) for _ in range(r.randint(1, 4))) for _ in range(r.choice([6, 40, 200]))]
        junk = i % 4 == 0
        if junk:
            at = r.randrange(len(w))
            w[at:at + 40] = [x + r.choice(["###", "$$$", "|"]) for x in w[at:at + 40]]
        out.append((i, " ".join(w) + ".\n", int(not junk)))
    return out


def test_measures_by_hand():
    t = ["", None, "  \n", "One two\ntwo 3a |", " ".join(f"w{i % 5}" for i in range(70)), "x"]
    x, pieces = Q.measures(pa.array(t))
    assert pieces.tolist() == [1, 1, 1, 1, 3, 1]
    assert x[:3, 0].tolist() == [0, 0, 0]
    one = x[3]
    assert np.isclose(one[0], 5 / 32) and np.isclose(one[1], 12 / 5 / 10) and np.isclose(one[2], 4 / 5)
    assert np.isclose(x[4][2], 5 / 32) and np.isclose(x[6][0], 6 / 32)
    alone, _ = Q.measures(pa.array([t[4]]))
    assert np.allclose(alone, x[4:7])


def test_gradients():
    r = np.random.default_rng(1)
    x, pieces, y = r.normal(size=(9, 5)), np.array([2, 4, 1, 2]), np.array([0.0, 1, 1, 0])
    m = Q.Attention(5)

    def loss():
        s = m.forward(x, pieces)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = m.gradients(m.forward(x, pieces), pieces, y)
    for k, p in m.p.items():
        for i in list(np.ndindex(p.shape))[:6]:
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-5 - grads[k][i]) < 1e-6


def test_held_out_accuracy_and_cases(spark):
    rows = texts(300, 3)
    docs = [(i, t, 0) for i, t, _ in rows] + [(1000, None, 0), (1001, "", 0), (None, "ka lo", 0), (1, rows[1][1], 0), (1002, "lo " * 200_000, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(spark, d, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score for r in Q.score(spark, docs, none).collect()] == [0.0]
    assert Q.score(spark, docs.limit(0), none).count() == 0
