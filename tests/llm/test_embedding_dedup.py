"""Links equal brute force where one leaf holds all; recall with many leaves; defined cases."""

import numpy as np
import pytest

from jobsignal.llm import embedding_dedup as E


def brute(rows, threshold=0.9):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    root = {i: i for i, _ in ids}
    near = {x: set() for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(ids):
        for y in ids[k + 1:]:
            a, b = np.array(x[1]), np.array(y[1])
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                near[x].add(y[0])
                near[y].add(x[0])
                p, q = find(x[0]), find(y[0])
                root[max(p, q)] = min(p, q)
    return {i: (len(near[i, v]), find(i), find(i) == i) for i, v in ids}


def cloud(n, seed, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    rows = []
    for i, b in enumerate(base):
        for _ in range(int(r.choice([1, 1, 1, 3]))):
            rows.append((len(rows), (b + r.normal(size=dim) * 0.2).tolist()))
    hot = r.normal(size=dim)
    rows += [(len(rows) + k, (hot + r.normal(size=dim) * 0.05).tolist()) for k in range(n // 6)]
    return rows


@pytest.mark.parametrize("leaf,least", [(1000, 1.0), (60, 0.95)])
def test_against_brute_force(spark, monkeypatch, leaf, least):
    monkeypatch.setattr(E, "LEAF", leaf)
    rows = cloud(150, leaf)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark, table).collect()}
    want = brute(rows)
    if least == 1.0:
        assert got == want
    assert sum(g[0] for g in got.values()) >= least * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_hot_group_of_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 50)
    r = np.random.default_rng(5)
    hot = r.normal(size=64)
    rows = [(i, (hot + r.normal(size=64) * 0.23).tolist()) for i in range(500)]
    rows += [(500 + i, r.normal(size=64).tolist()) for i in range(300)]
    one = r.normal(size=64)
    rows += [(800 + i, (one * (i + 1)).tolist()) for i in range(120)]  # no split parts vectors of one direction
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {x.vec_id: x.n_links for x in E.near_duplicates(spark, table).collect()}
    want = {i: w[0] for i, w in brute(rows).items()}
    assert all(got[i] == want[i] for i in range(800, 920))
    assert all(got[i] <= want[i] for i in want) and min(want[i] for i in range(500)) > 100
    assert sum(got[i] for i in range(500)) >= 0.97 * sum(want[i] for i in range(500))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []),
            (10, [1.0, 0.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark, table).collect()), key=repr)
    lone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 1, False), (11, 1, 11, True), (12, 1, 11, False), (None, 0, None, False), *lone], key=repr)
    assert E.near_duplicates(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.30, 0.34, 0.38, 0.42, 0.46])
def test_recall_in_groups_of_many_leaves(spread):
    """Groups in which few or many pairs are linked, beside unrelated vectors; all trees, without Spark."""
    r = np.random.default_rng(int(spread * 100))
    most, n = 250, 4000
    x = np.concatenate([r.normal(size=64) + r.normal(size=(n, 64)) * spread, r.normal(size=(400, 64))])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    linked = np.triu(x @ x.T >= 0.9, 1)
    share = linked[:n, :n].sum() / (n * (n - 1) / 2)
    found = np.zeros_like(linked)
    for tree in range(E.TREES):
        todo = [(1, np.arange(len(x)))]
        while todo:
            leaf, rows = todo.pop()
            taught = rows[r.permutation(len(rows))[: E.SAMPLE]]
            for part, new, blocks in E.route(x[rows], tree, leaf, E.fit_subtree(x[taught], tree, leaf, len(rows), 0.9, most)):
                if len(part) > most and not blocks and len(part) < len(rows):
                    todo.append((new, rows[part]))
                else:
                    found[np.ix_(rows[part], rows[part])] = True
    recall = (linked & found).sum() / linked.sum()
    print(spread, round(share, 4), round(recall, 4))
    assert recall >= 0.95
