"""Held-out accuracy, unseen misspellings, and the defined cases."""

import random
import zlib

import pyarrow as pa
import pytest

from jobsignal.llm import toxicity as X

VOCAB = ["river", "mountain", "reading", "letters", "garden", "window", "quiet", "morning", "paper", "bridge", "station", "yellow", "market", "singing", "harbour"]
BAD = ["grumblesnark", "vilewort", "slimetongue"]


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(VOCAB) + r.choice(["", "s", "ly", ","]) for _ in range(r.choice([5, 30, 300]))]
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(w) // 100):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    return X.train([(t, y) for _, t, y in texts(300, 1)])


def test_held_out_accuracy(model):
    rows = texts(200, 2)
    got = model.score(pa.array([t for _, t, _ in rows])) >= 0.5
    assert sum(g == bool(y) for g, (_, _, y) in zip(got, rows)) >= 195


def test_unseen_misspelling_shares_ngrams(model):
    seen = {w for _, t, _ in texts(300, 1) for w in t.split()}
    assert "grumblesnarkk" not in seen and "vilewortt" not in seen
    bad, clean = model.score(pa.array(["river paper grumblesnarkk bridge", "river paper stationn bridge"]))
    assert bad > 0.5 > clean


def test_means_are_adjoint():
    import numpy as np

    r = np.random.default_rng(3)
    row = np.sort(r.integers(0, 6, 20))
    m = X.Means(r.integers(0, 9, 20), row, np.maximum(np.bincount(row, minlength=6), 1), 9)
    x, g = r.normal(size=(9, 3)).astype("f4"), r.normal(size=(6, 3)).astype("f4")
    assert np.isclose((m.forward(x) * g).sum(), (x * m.backward(g)).sum(), atol=1e-4)


def test_whole_query(spark):
    rows = texts(240, 4)
    docs = [(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "river", "x"), (0, rows[0][1], "x")]
    labels = [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (2000, 1, None), (5, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    got = X.score(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_nothing_to_judge_by_rejects_nothing():
    rows = [(t, y) for _, t, y in texts(300, 1)]
    empty = pa.array([None, "", " \n", "river paper bridge"])
    few_clean = X.train([r for r in rows if r[1]] + [r for r in rows if not r[1]][:40])
    assert few_clean.score(empty)[:3].tolist() == [0.0, 0.0, 0.0]
    assert X.train([r for r in rows if r[1]]).score(empty).tolist() == [0.0] * 4
    assert X.train([r for r in rows if not r[1]]).score(empty).tolist() == [0.0] * 4


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.score for r in X.score(spark, docs, none).collect()] == [0.0, 0.0]
    assert X.score(spark, docs.limit(0), none).count() == 0
