"""The audit against a plain simulation of all orders, and the defined cases."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from jobsignal.llm import filter_audit as X


def plain(docs, labels):
    """Rows of the audit, document by document and order by order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        removed_of = defaultdict(int)
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                removed_of[f] += len(gone)
                mine.append((part, "".join(order), k, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone),
                             sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, removed_of[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def cases():
    long = " ".join(f"w{i}" for i in range(250))
    same = "word " * 300
    return [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (4, same, "en"), (5, same, None), (None, same, "en"), (None, long, ""),
            (6, None, None), (7, "", "de"), (8, " \t\n", "de"), (9, "ABC DEF", "en"), (10, long + " $", "de"), (11, "a" * 100_000, "en"),
            (12, "x y é" + long, "fr"), (2, "other text", "en"), (13, "lead  " + long + "  ", "fr"), (14, "UPPER " * 400 + "|", "fr")]


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (3, None, None), (9, 1, 1), (77, 1, 1), (12, 1, 0), (4, 0, 1)]


def test_equals_plain_simulation(spark):
    docs = spark.createDataFrame([(*r, 7, "x") for r in cases()], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    labels = spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, good int")
    got = sorted(tuple(r) for r in X.audit(docs, labels).collect())
    assert got == plain(cases(), LABELS)
    assert len(got) == 600 * 4


def test_walk_equals_direct_counts():
    r = np.random.default_rng(3)
    masks, counts = np.arange(32), r.integers(0, 9, (32, 3))
    states = X.walk(masks, counts)
    for subset in range(32):
        assert (states[subset] == counts[(masks & subset) == 0].sum(0)).all()


def test_text_longer_than_a_page_and_no_rows(spark):
    text = "Word " * 400_000
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in X.audit(docs, labels).collect()) == plain([(1, text, "en"), (2, text, "en")], [])
    assert X.audit(docs.limit(0), labels).collect() == []


def test_labels_of_a_small_file_do_not_pass_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "en") for i in range(40)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    out = X.audit(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels"))
    assert len(out.collect()) == 600
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
