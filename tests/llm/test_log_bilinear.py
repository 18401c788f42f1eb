"""Unigram figures against plain Python, normalised probabilities, gradients, held-out gain, and the defined cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jobsignal.llm import log_bilinear as X


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [None]


def rest(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def plain(docs):
    c = Counter(t for i, text in docs if rest(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return sorted(((i, rest(i) == 0, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                    math.fsum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in docs), key=lambda r: str(r[:4]))


def corpus(n, seed):
    """Two invented languages: the words before a word tell which follow."""
    r = random.Random(seed)
    words = [["".join(r.choice(s) for _ in range(r.randrange(1, 6))) for _ in range(300)] for s in (["ba", "no", "ri"], ["tes", "lu", "qué"])]
    return [(i, " ".join(words[i % 2][int(300 * r.random() ** 2)] for _ in range(r.choice([3, 40, 200])))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(X, "FREQUENT", 200)  # read by the driver only


def scored(spark, docs):
    df = spark.createDataFrame([(*d, 1.5, 2, "x") for d in docs], "doc_id long, text string, score double, n_tokens int, key string").repartition(3)
    return X.score(spark, df).collect()


def figures(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, pytest.approx(r.base_score, rel=1e-9, abs=1e-9)) for r in rows), key=lambda r: str(r[:4]))


def test_unigram_figures_and_gain(spark):
    docs = corpus(400, 3) + [(1000, None), (1001, ""), (1002, " \t\r\n\x0b\x0c"), (1003, "AÉ b c d É\x1cx"), (None, "ba no"), (1004, "z" * 5000 + " unseen"),
                             (1005, "Y" * 100), (1006, "y" * 100), (3, "ba no ri"), (3, "ba no ri")]
    got = scored(spark, docs)
    assert figures(got) == plain(docs)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({round(r.score, 6) for r in got if r.doc_id == 3}) <= 2


def test_rare_words_by_the_shuffle(spark, small):
    docs = corpus(120, 5) + [(2000, "word" * 40 + " ba"), (2001, "word" * 40)]
    assert figures(scored(spark, docs)) == plain(docs)


def test_nothing_to_learn_from_and_no_documents(spark):
    docs = [(None, "a b"), (next(i for i in range(100) if rest(i) == 0), "a")]
    assert figures(scored(spark, docs)) == plain(docs)
    assert scored(spark, []) == []


def test_one_long_text(spark):
    docs = [(1, "ba no lu " * 200_000), (2, "ba")]
    assert figures(scored(spark, docs)) == plain(docs)


def known():
    words = [f"w{i}" for i in range(400)]
    counts = np.arange(400, 0, -1)
    v = X.Vocabulary(pa.array(words[:300]), counts[:300], 50, int(counts.sum()) + 50, 401, np.zeros(0))
    v.class_sum = np.full(X.CLASSES, X.ADDED)
    for w, c in list(zip(words, counts))[v.own:]:
        v.class_sum[X.word_class(pa.array([w]))[0]] += c + X.ADDED
    return v, words, counts


def test_probabilities_of_all_tokens_sum_to_one():
    v, words, counts = known()
    mass = v.unit_mass()
    assert np.isclose(mass.sum(), v.tokens + X.ADDED * (v.distinct + X.CLASSES))
    model = X.Model.start(mass)
    r = np.random.default_rng(1)
    model.out += r.normal(0, 0.5, model.out.shape).astype("f4")
    context = r.integers(0, X.UNITS, (5, X.CONTEXT))
    units = np.arange(X.UNITS)
    for row in context:
        p = np.exp(model.log_probabilities(np.repeat(row[None], X.UNITS, 0), units).astype(float))
        of, _ = v.units(pa.array(words))
        total = p[0] + sum(p[u] if u < X.UNITS - X.CLASSES else p[u] * (c + X.ADDED) / mass[u] for u, c in zip(of, counts))
        total += sum(p[u] * X.ADDED / mass[u] for u in range(X.UNITS - X.CLASSES, X.UNITS))
        assert abs(total - 1) < 1e-4
        # the same by a plain loop
        h = [sum(float(model.vectors[row[k], d]) * float(model.place[k, d]) for k in range(X.CONTEXT)) for d in range(X.WIDTH)]
        logits = [sum(a * float(b) for a, b in zip(h, model.out[u])) + float(model.bias[u]) for u in units]
        z = math.log(sum(math.exp(x) for x in logits))
        assert np.allclose(np.log(p + 1e-300)[p > 0], np.array([x - z for x in logits])[p > 0], atol=1e-3)


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(X, "UNITS", 12)
    monkeypatch.setattr(X, "WIDTH", 4)
    r = np.random.default_rng(4)
    wide = lambda *s: r.normal(0, 0.5, s)
    model = X.Model(wide(12, 4), wide(X.CONTEXT, 4), wide(12, 4), wide(12))
    context, unit, noise = r.integers(0, 12, (30, X.CONTEXT)), r.integers(0, 12, 30), r.integers(0, 12, 7)
    log_noise = np.log(7 * np.full(12, 1 / 12))

    def loss():
        total = 0.0
        for c, u in zip(context, unit):
            h = sum(model.vectors[c[k]] * model.place[k] for k in range(X.CONTEXT))
            s = lambda j: h @ model.out[j] + model.bias[j] - log_noise[j]
            total += math.log1p(math.exp(-s(u))) + sum(math.log1p(math.exp(s(j))) for j in noise)
        return total / len(unit)

    grads = X.gradients(model, context, unit, noise, log_noise)
    for value, g in zip(model.parts(), grads):
        flat = value.reshape(-1)
        for i in r.integers(0, flat.size, 6):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - np.asarray(g).reshape(-1)[i]) < 1e-4


def test_contexts_stop_at_the_start_of_a_text():
    unit, n = np.array([5, 6, 0, 0, 7, 0], np.int16), np.array([3, 1, 2])
    got = X.contexts(unit, n)
    assert got[:, :2].tolist() == [[0, 0], [5, 0], [6, 5], [0, 0], [0, 0], [7, 0]]
