"""Steps of the store queries that grew faster than they need: passes over the history, work done twice."""

import pytest
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.operators import classify as C
from jobsignal.operators import store as S
from jobsignal.plans import store as PS
from tests.test_shared_scans import SF, static

SCHEMA = "seq long, provider string, external_job_id string, company string, title string, location string, url string, description string, observed_ts long, raw_json string"


def rows(n=600):
    """Postings with one to four contents; times repeat, some lie before 1970 or are null, rows repeat."""
    out = []
    for i in range(n):
        job, content = i % 23, (i * i // 7) % (1 + i % 23 % 4)
        t = None if i % 97 == 5 else (i * 7919) % 90_000 - 20_000
        out.append((i // 2 * 2, "lever", f"p{job}", "co", f"Backend Engineer {content}", "Remote", None if job == 3 else "u", "d", t, f"{{{i}}}"))
    return out


def test_upsert_shuffles_the_history_twice(spark):
    plan = static(spark, lambda: S.upsert(PS.versions(spark, SF)))
    assert sum(" Exchange hashpartitioning" in line or "- Exchange hashpartitioning" in line for line in plan.splitlines()) <= 7
    assert plan.count("ReusedExchange") >= 1


def test_jobs_tell_when_their_content_was_first_observed(spark):
    df = spark.createDataFrame([r for r in rows() if r[8] is not None], SCHEMA)
    jobs = S.upsert(df, observed="classified_ts")
    assert jobs.drop("classified_ts").exceptAll(S.upsert(df)).count() == 0
    plain = S.classify_current(df, jobs.drop("classified_ts"))
    quick = S.classify_current(df, jobs)
    assert quick.count() == plain.count() == 23 and quick.exceptAll(plain).count() == 0


@pytest.mark.parametrize("state", [False, True])
def test_upsert_equals_the_plain_form(spark, state):
    df = spark.createDataFrame([(2 * i, *r[1:]) for i, r in enumerate(rows()) if r[8] is not None], SCHEMA)
    held = S.upsert(df.where("observed_ts < 10000")) if state else None
    batch = df.where("observed_ts >= 10000") if state else df
    a, b = (S.upsert(batch, held, bucket_seconds=x) for x in (S.BUCKET_SECONDS, None))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_recorded_across_batches(spark):
    df = spark.createDataFrame([(k, 1, t, k * 10) for k in range(5) for t in range(-50, 40 + k)] + [(9, 1, None, 90), (9, 1, 3, 90)], "k int, _v int, _t long, kept long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.k: tuple(r)[1:] for r in S.recorded(df, ["k"], 20, ("kept",)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {**{k: (k * 10, 1, -50, 30) for k in range(5)}, 9: (90, 1, None, None)}


@pytest.mark.parametrize("query", [PS.top_role_types, PS.role_type_distribution, PS.seniority_distribution, PS.latest_high_relevance])
def test_reports_read_the_history_only_for_the_jobs(spark, query):
    assert static(spark, lambda: query(spark, SF)).count("orders.parquet") == 0


def test_snapshot_reads_the_history_once_after_the_jobs(spark):
    assert static(spark, lambda: PS._current(spark, SF)[0]).count("orders.parquet") == 0
    assert static(spark, lambda: PS.intelligence_snapshot(spark, SF)).count("orders.parquet") == 1


def test_cache_is_classified_once(spark):
    assert static(spark, lambda: PS.classify_if_needed(spark, SF)).count("Generate inline") <= 1


def test_title_is_searched_for_what_the_text_holds(spark):
    df = spark.createDataFrame([("Backend Engineer, backend", "platform engineer"), ("Chef", "api engineer backend"), ("", "")], "title string, description string")
    texts = df.select(F.concat(F.lit(" "), F.lower(F.regexp_replace("title", ",", "")), F.lit(" ")).alias("pt"), "description").withColumn("full", F.concat("pt", "description", F.lit(" ")))
    score = C._label_score(F.col("pt"), F.col("full"), R.ROLE_FAMILY_PATTERNS["software_engineering"])
    assert [r[0] for r in texts.select(score).collect()] == [4 + 1, 2, 0]
    assert "filter(" not in str(score)
