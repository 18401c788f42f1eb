"""The stream equals the batch queries for every split, replays and crashes change nothing, one key rewrites one bucket."""

import pytest
from pyspark.sql import functions as F

from jobsignal.operators import normalize as N
from jobsignal.sources import landed as L
from jobsignal.streaming import ingest as I
from jobsignal.streaming import pipeline as SP
from jobsignal.streaming.state import Batch, State

TABLES = ["jobs", "classifications", "notified", "board_state", "alerts", "outcomes"]


def gh(i, title="Software Engineer", place="Remote - United States"):
    return f'{{"id":{i},"title":"{title}","location":{{"name":"{place}"}},"content":"<p>x</p>"}}'


def response(seq, service, source, ts, body, status=200, kind=None, message=None):
    return (seq, service, source, status, kind, message, f"e{seq}", f"m{seq}", ts, body)


SCHEMA = "seq long, service string, source string, http_status int, error_kind string, error_message string, etag string, last_modified string, fetched_ts long, body string"


def small(spark):
    lever = '[{"id":"L1","text":"Full Stack Engineer","categories":{"location":"New York, NY"},"updatedAt":5}]'
    rows = [
        response(1, "greenhouse", "acme", 100, f'{{"jobs":[{gh(1)},{gh(2, "Recruiter")},{gh(1, "Backend Engineer")}]}}'),
        response(2, "greenhouse", "acme", 200, f'{{"jobs":[{gh(1, "Backend Engineer")},{gh(3)}]}}'),
        response(3, "lever", "duo", 210, lever), response(4, "lever", "duo", 220, None, 304), response(5, "lever", "duo", 230, "[{", 200),
        response(6, "ashby", "trio", 240, '{"errors":[{"message":"no"}]}'), response(7, "greenhouse", "gone", 250, None, None, "task", "OperationalError"),
        response(8, "greenhouse", "acme", 30000, f'{{"jobs":[{gh(2, "Platform Engineer")},{gh(3)}]}}'), response(9, "lever", "duo", 30010, lever),
        response(10, "greenhouse", "solo", 30020, '{"jobs":[{"id":9,"title":"","location":"x"}]}')]
    return spark.createDataFrame(rows, SCHEMA)


def tables(state):
    return {t: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) for t in TABLES if (df := state.read(t)) is not None}


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def whole(spark):
    return tables(SP.ingest_stream(spark, small(spark), []))


def test_one_batch_equals_the_batch_operators(spark, whole):
    status = {r.seq: r.status for r in N.board_result(small(spark)).collect()}
    got = {r[4]: r[7] for r in whole["outcomes"]}  # columns by name: detail, fetched_ts, new_matches, postings, seq, service, source, status
    assert got == status and got[7] == "task_exception:OperationalError" and got[1] == "new match"
    texts = [r[4] for r in whole["alerts"]]
    assert len(texts) == 4 and any("Platform Engineer" in t for t in texts) and sum("Backend Engineer" in t for t in texts) == 1
    assert not any(r[-1] == "gone" for r in whole["board_state"])


@pytest.mark.parametrize("cuts", [[205, 245], [101, 201, 211, 221, 231, 241, 251, 30001, 30011]])
def test_any_split_equals_one_batch(spark, whole, cuts):
    assert tables(SP.ingest_stream(spark, small(spark), cuts)) == whole


def test_crash_after_each_write_and_replay_change_nothing(spark, whole, tmp_path, monkeypatch):
    real = {n: getattr(Batch, n) for n in ("write", "append", "commit")}
    for stop in (2, 6):
        root = f"{tmp_path}/crash{stop}"
        done = [0]

        def counted(name):
            def call(self, *a):
                out = real[name](self, *a) if name != "commit" else None
                done[0] += 1
                if self.number == 1 and done[0] >= stop:
                    raise OSError("executor lost")
                return out if name != "commit" else real[name](self)
            return call

        with monkeypatch.context() as m:
            for n in real:
                m.setattr(Batch, n, counted(n))
            with pytest.raises(Exception):  # noqa: B017
                SP.ingest_stream(spark, small(spark), [205], root)
        state = State(spark, root, I.KEYS)
        assert state.manifests() == [0]
        before = tables(state)
        assert all(r[4] in (1, 2) for r in before["outcomes"])
        again = I.ingest(spark, small(spark).schema, f"{root}/landing", root, SP._run)
        assert tables(again) == whole
        assert again.begin(0) is None and again.begin(1) is None
    again.vacuum()
    assert tables(again) == whole


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    rows = small(spark)
    more = spark.createDataFrame([response(20, "greenhouse", "acme", 40000, f'{{"jobs":[{gh(1, "Backend Engineer New")}]}}')], SCHEMA)
    state = SP.ingest_stream(spark, rows.unionByName(more), [35000], str(tmp_path))
    first, second = state.manifest(0)["keyed"]["jobs"], state.manifest(1)["keyed"]["jobs"]
    assert len(first) > 1 and sum(first.get(k) != v for k, v in second.items()) == 1
    names = [s.getPath().getName() for s in state.fs.listStatus(state._path(f"{tmp_path}/jobs/v=1"))]
    assert sum(n.startswith("bucket=") for n in names) == 1


def test_failed_batch_leaves_its_error_and_the_next_goes_on(spark, tmp_path):
    def step(b, batch, rules):
        I.ingest_batch(b, batch, rules)
        if b.number == 1:
            raise KeyError("poisoned")

    state = SP.ingest_stream(spark, small(spark), [205, 245], str(tmp_path), isolate=True, step=step)
    got = {(r.seq, r.status) for r in state.read("outcomes").collect()}
    assert (3, "cycle_exception:KeyError") in got and (6, "cycle_exception:KeyError") in got
    assert {s for s, _ in got} == {1, 2, 3, 6, 7, 8, 9, 10}
    assert {r.seq for r in state.read("failed").collect()} == {3, 4, 5, 6}
    assert {r.external_job_id for r in state.read("notified").where("service = 'lever'").collect()} == {"L1"}


def test_poisoned_board_leaves_the_others_equal(spark):
    rows = small(spark)
    clean = {r.seq: tuple(r) for r in N.board_result(rows).collect()}
    bad = rows.withColumn("error_kind", F.when(F.col("seq") == 3, "task").otherwise(F.col("error_kind"))).withColumn(
        "error_message", F.when(F.col("seq") == 3, "TypeError").otherwise(F.col("error_message"))).withColumn(
        "body", F.when(F.col("seq") == 3, F.lit(None)).otherwise(F.col("body")))
    got = {r.seq: tuple(r) for r in N.board_result(bad).collect()}
    assert got[3][4] == "task_exception:TypeError" and all(got[k] == clean[k] for k in clean if k not in (3, 9))


def test_landed_lost_task_needs_no_body(spark):
    assert L.explode_postings(small(spark).where("seq = 7")).count() == 0
