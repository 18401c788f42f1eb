"""One scan per use of the history that must differ, and character classes that the regex engine looks up."""

import json

from pyspark.sql import functions as F

from jobsignal.functions import text as X
from jobsignal.operators import store as S
from jobsignal.plans import store as PS

SF = "/root/testdata/sf0.001"


def plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


def static(spark, make):
    """The plan with its reused exchanges, as it stands without re-planning while it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan(spark, make())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_upsert_scans_its_versions_twice(spark):
    assert static(spark, lambda: S.upsert(PS.versions(spark, SF))).count("FileScan") == 2


def test_reports_compute_the_jobs_once(spark):
    orders = "orders.parquet"
    assert static(spark, lambda: PS.high_relevance_jobs(spark, SF)).count(orders) == 1


def test_hash_and_classifier_use_no_ranges(spark):
    v = PS.versions(spark, SF)
    assert "#-\\[" not in plan(spark, S.with_hash(v)) and "a-z0-9" not in plan(spark, v.select(X.norm_text(F.col("title"))))


def test_classes_mean_what_they_did(spark):
    chars = [chr(i) for i in [*range(0, 0x3001), 0xFFFD, 0x1F600] if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(f"a{c}{c}b{c}",) for c in chars], "t string")
    got = df.select("t", X.json_string(F.col("t")), X.compact_text(F.col("t")), X.norm_text(F.col("t")),
                    F.trim(F.regexp_replace("t", f"{X.R.WS}+", " ")), F.trim(F.regexp_replace(F.lower("t"), "[^a-z0-9.+#-]+", " "))).collect()
    assert [r[1] for r in got] == [json.dumps(r[0]) for r in got]
    assert [r[2] for r in got] == [r[4] for r in got] and [r[3] for r in got] == [r[5] for r in got]
