"""Chunks and removals equal a plain-Python version; passages that move are still found; defined cases."""

import hashlib
import random

from jobsignal.llm import line_dedup as L


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, cur = [], []
    for i, x in enumerate(lines):
        cur.append(x)
        if i and (h[i - 1] * 31 + h[i]) % L.DIVISOR == 0:
            out.append(cur)
            cur = []
    return out + [cur] if cur else out


def brute(rows):
    seen, out = {}, {}
    for doc_id, text in sorted({(i, t) for i, t in rows if t is not None and i is not None}) + sorted({(i, t) for i, t in rows if t is not None and i is None}, key=repr):
        kept = []
        for k, c in enumerate(chunks(text)):
            t = "\n".join(c)
            first = seen.setdefault(t, (doc_id, text, k))
            if len(c) < 2 or not t.strip(" \t\n\x0b\f\r") or first == (doc_id, text, k):
                kept.append(t)
        out[doc_id, text] = "\n".join(kept)
    return out


def test_equals_plain_python(spark):
    r = random.Random(4)
    shared = [[f"shared {k} line {i} ä" for i in range(12)] for k in range(5)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "\n\n"), (4, "one line"), (5, "one line")]
    for i in range(6, 90):
        text = [f"own {r.random()}" for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(text))
            text[k:k] = r.choice(shared)
        rows.append((i, "\n".join(text)))
    rows += [(20, rows[20][1]), (200, rows[21][1]), (21, rows[21][1]), (300, "\n".join(f"long {i}" for i in range(5000))), (301, "\n".join(f"long {i}" for i in range(5000)))]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 7, "keep") for i, t in rows], "doc_id long, text string, n_chars long, gone string").repartition(3)
    got = L.dedup(spark, docs, counts=False)
    assert got.columns == docs.columns
    want = brute(rows)
    given = sorted((i, t) for i, t in rows if t is not None)
    out = {}
    for x in got.collect():
        assert x.gone == "keep" and x.n_chars == (None if x.text is None else len(x.text))
        out.setdefault(x.doc_id, []).append(x.text)
    for i in {i for i, _ in rows}:
        assert sorted(map(repr, out[i])) == sorted(repr(want.get((i, t))) for j, t in rows if j == i)
    assert len(given) + 1 == sum(map(len, out.values())) and out[301] != out[300]


def test_missing_ids_come_last_and_empty_table(spark):
    body = "\n".join(f"line {i}" for i in range(9))
    docs = spark.createDataFrame([(None, body), (8, body)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup(spark, docs).collect()}
    assert got[8] == body and len(got[None]) < len(body)
    assert L.dedup(spark, docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = L.dedup(spark, docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
