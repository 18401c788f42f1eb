"""Plan-shape checks for the scale claims in the README."""

from pyspark.sql import functions as F

from jobsignal.operators import classify as C
from jobsignal.sources.testdata import spread, v_postings


def test_spread_only_on_request(spark):
    few = spark.range(1000).coalesce(1)
    assert spread(few, "id") is few
    spark.conf.set("spark.jobsignal.inputPartitions", "5")
    try:
        assert spread(few, "id").rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.jobsignal.inputPartitions")


def test_relevance_filter_stays_above_classifier(spark):
    df = C.classify(v_postings(spark, "/root/testdata/sf0.001")).where(F.col("relevance_score") >= 75)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [ln.strip() for ln in plan.split("\n")]
    filt = next(i for i, ln in enumerate(lines) if "relevance_score" in ln and "Filter" in ln)
    gen = next(i for i, ln in enumerate(lines) if "Generate" in ln)
    assert filt < gen  # the filter is printed above (applied after) the Generate fence


def test_scan_reads_only_needed_columns(spark):
    df = C.classify(v_postings(spark, "/root/testdata/sf0.001")).select("doc_id", "relevance_score")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "lang" not in plan  # unused document columns never reach the scan
