"""One scrape: plan shape, and samples of a small status table held against values written by hand."""

import re

from jobsignal.operators import metrics as M
from jobsignal.plans.registry import QUERIES

STATUS = ("service string, source string, status string, detail string, is_error int, last_checked_ts long, last_ok_ts long, "
          "last_error_ts long, consecutive_errors int")
ROWS = [("ashby", "a", "ok", None, 0, 50, 50, None, 0),
        ("ashby", 'b"1', "timeout", "x", 1, 70, None, 70, 3),
        ("lever", "c", "ok", "", 0, 60, 60, 40, 0)]


def _by_name(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["metric"].removeprefix(M.PREFIX), {})[r["labels"]] = (r["value"], r["value_text"])
    return out


def test_scrape_reads_each_table_once(spark):
    df = QUERIES["sink_metrics"].build(spark, "/root/testdata/sf0.001")
    qe = df._jdf.queryExecution()
    plan = qe.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")[0]
    assert len(re.findall(r"Exchange \(", plan.replace("BroadcastExchange", ""))) <= 12


def test_three_grains_of_the_status_table(spark):
    got = _by_name(M.status_samples(spark.createDataFrame(ROWS, STATUS)))
    assert got["exporter_up"] == {"": (1.0, "1")} and got["status_db_readable"] == {"": (1.0, "1")}
    assert got["status_db_last_scrape_timestamp_seconds"] == {"": (70.0, "70")}
    assert got["sources_total"] == {'service="ashby"': (2.0, "2"), 'service="lever"': (1.0, "1")}
    assert got["source_errors"] == {'service="ashby"': (1.0, "1"), 'service="lever"': (0.0, "0")}
    assert got["source_error_ratio"] == {'service="ashby"': (0.5, "0.5"), 'service="lever"': (0.0, "0.0")}
    assert got["source_consecutive_errors"]['service="ashby",source="b\\"1",status="timeout"'] == (3.0, "3")
    assert got["source_last_error_timestamp_seconds"] == {
        'service="ashby",source="b\\"1",status="timeout"': (70.0, "70"), 'service="lever",source="c",status="ok"': (40.0, "40")}
    assert len(got["source_error_state"]) == len(got["source_last_checked_timestamp_seconds"]) == 3


def test_scrape_without_boards_still_says_that_it_is_up(spark):
    got = _by_name(M.status_samples(spark.createDataFrame([], STATUS)))
    assert got == {"exporter_up": {"": (1.0, "1")}, "status_db_readable": {"": (1.0, "1")},
                   "status_db_last_scrape_timestamp_seconds": {"": (None, None)}}


def test_cycle_without_a_summary_keeps_its_other_samples(spark):
    latest = spark.createDataFrame(
        [("ashby", 3600, "error", '{"new match": 2, "timeout": 1}', 1, 2, 1500), ("lever", 7200, "ok", None, 0, 0, None)],
        "service string, last_cycle_ts long, status string, summary_json string, error_count long, ok_count long, cycle_duration_ms long")
    got = _by_name(M.cycle_samples(latest))
    assert got["service_cycle_sources"] == {'service="ashby",source_status="new match"': (2.0, "2"), 'service="ashby",source_status="timeout"': (1.0, "1")}
    assert got["service_cycle_duration_seconds"] == {'service="ashby"': (1.5, "1.5"), 'service="lever"': (0.0, "0.0")}
    assert got["service_cycle_status"] == {'service="ashby",status="error"': (1.0, "1"), 'service="lever",status="ok"': (1.0, "1")}
    assert got["service_cycle_error_sources"]['service="lever"'] == (0.0, "0")
