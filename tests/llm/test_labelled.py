"""The taught rows don't depend on how the tables are split."""

from jobsignal.llm import labelled


def test_repeated_ids_teach_the_same_text_on_every_split(spark):
    rows = [(i % 40, f"text {i} of {i % 7}") for i in range(400)] + [(None, "no id"), (3, None), (5, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    seen = []
    for parts, order in ((1, 1), (7, -1), (3, 1)):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(parts)
        seen.append(labelled.sample(docs, labels, "toxic", {0: 100, 1: 100}))
    assert seen[0] == seen[1] == seen[2] and 25 < len(seen[0]) <= 40
    assert {t for t, _ in seen[0]} <= {t for i, t in rows if t}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert labelled.sample(empty, spark.createDataFrame([], "doc_id long, toxic int"), "toxic", {0: 5, 1: 5}) == []
