"""Each stage of the pipeline against what its operator's plain version says about the stage's own input."""

import random

import pytest

import corpus_pipeline as P

WORDS = "river mountain reading letters garden window quiet morning paper bridge station yellow market singing harbour".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))
    shared = "\n".join(say(6) for _ in range(40))
    item = say(20)
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        text = "\n".join(say(r.randint(4, 12)) for _ in range(r.randint(2, 9)))
        if bad:
            text += " " + " ".join(["vilewort"] * 2 + ["grumblesnark"])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    lines = "\n".join(say(8) for _ in range(3))
    base = " ".join(say(90).split())
    extra = [shared + "\n" + lines, say(40) + "\n" + shared, base, base + " onemore", item + " " + say(10), say(30), None, ""]
    rows += [(200 + k, t, "en", "x", len(t or "")) for k, t in enumerate(extra)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").persist()
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns, name
        kept[name] = {r.doc_id: r for r in docs.collect()}
    after = list(kept.values())
    assert not any(i % 4 == 0 for i in after[0] if i < 120) and len([i for i in after[0] if i < 120]) >= 85
    assert {200, 201, 202, 203, 204, 205, 206, 207} <= set(after[0])
    assert set(after[1]) == set(after[0])
    assert len(after[1][201].text) < after[0][201].n_chars and after[1][201].n_chars == len(after[1][201].text)
    assert set(after[1]) - set(after[2]) == {203}
    assert set(after[2]) - set(after[3]) == {204}
    out = P.STAGES[-1][1](spark, docs, folder).collect()
    assert len(out) == len(after[3]) and all(r.lossless for r in out if r.ids is not None)
    assert [r.doc_id for r in out if r.ids is None] == [206]
