"""Links, threads and order against a plain-Python version; defined cases; no Python in the plan."""

import random
import re

import pytest

from jobsignal.llm import quotes as Q

MARK = re.compile(r"^\s{0,3}(>[> ]*)")


def norm(x):
    return re.sub(r"\s+", " ", x.lower()).strip(" ")


def runs(text):
    out, last = [], (-1, "")
    for i, x in enumerate(text.split("\n")):
        m = MARK.match(x)
        level, says = (m[1].count(">"), x[m.end():]) if m else (0, x)
        if level != last[0] or (last[1].strip(" ") == "" and says.strip(" ") != ""):
            out.append((level, i, []))
        out[-1][2].append(says)
        last = (level, says)
    return [(lv, i, ls) for lv, i, ls in out if "\n".join(ls).strip(" ")]


def own(text):
    lines = text.split("\n")
    kept = [x for x in lines if not MARK.match(x)]
    return text if len(kept) == len(lines) else "\n".join(kept).strip(" ")


def brute(conv):
    """turn -> (parent, thread, n_quotes, n_linked, text), and the turns in reply order."""
    known, facts = {}, {}
    for turn, text in sorted(conv.items()):
        links = []
        for lv, i, ls in runs(text or ""):
            if lv:
                best = max((len(norm(x)), norm(x)) for x in ls)[1]
                src = known.get(("p", norm("\n".join(ls)))) if ("p", norm("\n".join(ls))) in known else known.get(("l", best))
                if src is not None:
                    links.append((lv, i, src))
        parent = min(links)[2] if links else None
        facts[turn] = (parent, turn if parent is None else facts[parent][1], len([1 for lv, _, _ in runs(text or "") if lv]), len(links), None if text is None else own(text))
        if text is not None:
            known[("p", norm(own(text)))] = turn
            for lv, _, ls in runs(text):
                if not lv:
                    known[("p", norm("\n".join(ls)))] = turn
                    for x in ls:
                        known[("l", norm(x))] = turn
    return facts, sorted(facts, key=lambda t: (facts[t][1], t))


def make(seed):
    r = random.Random(seed)
    convs = {}
    for c in range(12):
        msgs = {}
        for t in range(r.choice([1, 4, 9, 30])):
            parts = []
            for _ in range(r.choice([0, 0, 1, 2])):
                if msgs:
                    src = msgs[r.choice(list(msgs))] or "lost words"
                    lines = src.split("\n")
                    k = r.randrange(len(lines))
                    pick = r.choice([lines, lines[k:k + 1], lines[k:k + 2]])
                    parts.append("\n".join(r.choice(["> ", ">", " > "]) + x.upper() if r.random() < 0.5 else "> " + x for x in pick))
            parts.append("\n".join(f"{r.choice(['Yes', 'No', 'Maybe'])} {r.randint(0, 12)} {r.choice(['x', 'y'])}" for _ in range(r.randint(1, 3))))
            r.shuffle(parts)
            msgs[t * r.choice([1, 1, 2]) if t not in msgs else t] = r.choice([parts[0], r.choice(["\n", "\n\n"]).join(parts)])
        convs[c] = msgs
    convs[3][max(convs[3]) + 1] = None
    convs[4][max(convs[4]) + 1] = ""
    return convs


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    convs = make(block)
    rows = [(c, t, "user", x, 1) for c, m in convs.items() for t, x in m.items()]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h int").repartition(3)
    got = {(r.conv_id, r.turn): r for r in Q.conversations(spark, table).collect()}
    assert len(got) == len(rows)
    linked = 0
    for c, m in convs.items():
        facts, order = brute(m)
        for t in m:
            r = got[c, t]
            assert (r.parent_turn, r.thread, r.n_quotes, r.n_linked, r.text) == facts[t]
            assert r.reply_order == order.index(t)
            linked += r.n_linked
    assert linked > 20


def test_defined_cases(spark):
    rows = [(1, 0, "Hello there\nfriend"), (1, 0, "Hello there\nfriend"), (1, 1, "> hello   THERE friend\nYes"), (1, 2, ">> Hello there\n>> friend\n> Yes\nI see"),
            (1, None, "> Yes"), (None, 3, "> Yes\nno"), (2, 0, "> Yes\nnot from here"), (2, 1, "> > >\n")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    got = sorted(((r.conv_id, r.turn, r.text, r.parent_turn, r.thread, r.n_quotes, r.n_linked, r.reply_order) for r in Q.conversations(spark, table).collect()), key=repr)
    assert got == sorted([(1, 0, "Hello there\nfriend", None, 0, 0, 0, 0), (1, 0, "Hello there\nfriend", None, 0, 0, 0, 0), (1, 1, "Yes", 0, 0, 1, 1, 2), (1, 2, "I see", 1, 0, 2, 2, 3),
                          (1, None, "", None, None, 0, 0, None), (None, 3, "no", None, None, 0, 0, None), (2, 0, "not from here", None, 0, 1, 0, 0), (2, 1, "", None, 1, 0, 0, 1)], key=repr)
    assert Q.conversations(spark, table.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, 0, "a")], "conv_id long, turn long, text string")
    plan = Q.conversations(spark, table)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
