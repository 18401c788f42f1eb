"""Window hits equal brute force; proximity, blocks, defined cases."""

import hashlib
import random
import re

import pytest

from jobsignal.llm import decontaminate as D


def words(t):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w = words(t)
        hit, own = set(), set()
        for item, text in items:
            v = words(text)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                p = v[k:k + window]
                for s in range(len(w) - len(p) + 1):
                    if w[s:s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        own.add("" if item is None else str(item))
        names = ",".join(sorted(own))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def data(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(25)] + ["the", "Of", "and"] * 8
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for i in range(25)]
    items += [(3, "and again, a second text"), (None, "nameless item here"), (90, None), (91, "..."), (10, items[4][1]), (92, "zzz the")]
    docs = [(0, None), (1, ""), (2, "...!"), (None, "one Nameless-item HERE two"), (3, "and again"), (3, "and again")]
    for i in range(4, 70):
        w = [r.choice(vocab) for _ in range(r.choice([3, 30, 300]))]
        for _ in range(r.choice([0, 0, 1, 3])):
            part = r.choice(items)[1] or ""
            k = r.randrange(len(w))
            w[k:k] = part.upper().split(" ") if r.random() < 0.3 else part.split(" ")
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs.append((99, "the the the " * 3000))
    return docs, items


@pytest.mark.parametrize("window,block", [(13, None), (4, None), (13, 300), (2, 500)])
def test_equals_brute_force(spark, monkeypatch, window, block):
    if block:
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = data(window)
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_words int, h string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(spark, d, b, window)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == brute(docs, items, window)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = [(1, "x alpha beta gamma delta y"), (2, "alpha so beta gamma delta"), (3, "beta z z z z z alpha"), (4, "alpha alone")]
    got = {r.doc_id: (r.n_hit, r.n_near) for r in D.contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), items, 13, 2).collect()}
    assert got == {1: (4, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_clean_and_empty(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma", 0), (1, "other words", 1), (None, "alpha beta gamma", 2), (None, "fine", 3), (5, None, 4)], "doc_id long, text string, kid int")
    assert sorted(r.kid for r in D.clean(spark, docs, items).collect()) == [1, 3, 4]
    assert D.clean(spark, docs, items).columns == docs.columns
    none = D.contamination(spark, docs, items.limit(0)).collect()
    assert len(none) == 5 and not any(r.contaminated for r in none) and none[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert D.contamination(spark, docs.limit(0), items).count() == 0
