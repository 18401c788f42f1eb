"""What the job streams leave on disk: texts written once, nothing that no later step reads."""

import time

import pytest
from pyspark.sql import functions as F

from jobsignal.operators import store as S
from jobsignal.streaming import pipeline as SP
from jobsignal.streaming import state as ST
from jobsignal.streaming.state import State

SCHEMA = "seq long, provider string, external_job_id string, company string, title string, location string, url string, description string, observed_ts long, raw_json string"
CUTS = [100_000, 200_000, 300_000]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(spark):
    """Ten jobs in four slices; the first two change their content in every slice, the third once."""
    out = []
    for k in range(4):
        for j in range(10):
            title = f"Backend Engineer {k if j < 2 else k // 2 if j == 2 else 0}"
            out.append((10 * k + j, "lever", f"p{j}", "co", title, "Remote", "u", f"text {j}", 100_000 * k + j, f"{{{10 * k + j}}}"))
    return spark.createDataFrame(out, SCHEMA)


def names(state, folder):
    path = state._path(f"{state.root}/{folder}")
    return [s.getPath().getName() for s in state.fs.listStatus(path)] if state.fs.exists(path) else []


def slices(state):
    return [n for n in names(state, "landing") if n.startswith("slice=")]


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("dead", [2, 0])
def test_texts_are_written_once_and_what_is_taken_goes(spark, tmp_path, monkeypatch, dead):
    monkeypatch.setattr(ST, "DEAD", dead)  # 0: every batch writes all anew
    jobs, late = SP.job_upsert_stream(spark, rows(spark), CUTS, root=str(tmp_path))
    assert same(jobs, S.upsert(rows(spark))) and late.count() == 0
    state = State(spark, str(tmp_path), {"jobs": S.KEY})
    assert slices(state) == []
    kept = state.manifest()["apart"]["jobs"]
    assert state.apart("jobs", kept["spans"]).count() == (10 + 2 + 3 + 2 if dead else 10)
    narrow = state.narrow(state.manifest(), "jobs")
    assert set(narrow.columns) == {*S.KEY, "content_hash", "first_seen_ts", "last_seen_ts", "_held"}
    assert len(names(state, "jobs")) == 2 and len(names(state, "jobs-apart")) == (4 if dead else 2)
    state.vacuum()
    assert len(names(state, "jobs")) == 1 and same(state.read("jobs"), S.upsert(rows(spark)))


def test_late_rows_change_nothing(spark, tmp_path):
    old = rows(spark).where("observed_ts < 100000").withColumn("seq", F.col("seq") + 1000)
    jobs, late = SP.job_upsert_stream(spark, rows(spark), CUTS, late=old, root=str(tmp_path))
    assert same(jobs, S.upsert(rows(spark)))
    assert sorted(r.seq for r in late.collect()) == list(range(1000, 1010))


def test_classify_stream_keeps_two_versions(spark, tmp_path):
    got = SP.classify_stream(spark, rows(spark), CUTS, root=str(tmp_path))
    assert got.exceptAll(S.classify_versions(rows(spark))).count() == 0 and got.count() == 10 + 3 * 2 + 1
    state = State(spark, str(tmp_path), {"jobs": S.KEY, "classifications": S.KEY})
    assert slices(state) == []
    assert len(names(state, "classifications")) == 2 and len(names(state, "jobs")) == 2


def test_landing_leaves_no_shuffle_files(spark, tmp_path):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    setting = spark.conf.get(SP.FREED, None)
    SP.land_slices(rows(spark).groupBy("external_job_id").agg(F.max("observed_ts").alias("observed_ts")), f"{tmp_path}/landing", "observed_ts", CUTS)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(SP.FREED, None) == setting
