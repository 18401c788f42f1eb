"""Long-form snapshot: entries, their order keys and display fields."""

import json

from jobsignal.operators import snapshot as SN

STATUS = "service string, source string, status string, detail string, is_error int, last_checked_ts long, last_error_ts long, consecutive_errors int"


def test_active_errors_stand_in_two_sections_newest_first(spark):
    rows = [("lever", "b", "http_500", None, 1, 20, 10, 1), ("lever", "a", "http_500", 'naïve "x"', 1, 20, 20, 3), ("lever", "c", "http_500", "", 1, 20, 20, 2)]
    out = SN.active_errors(spark.createDataFrame(rows, STATUS)).select(*SN.COLUMNS).collect()
    for section in ("active_errors", "error_groups"):
        entries = sorted((r for r in out if r.section == section), key=lambda r: (r.part, r.order_1, r.order_2))
        shown = [json.loads(r.row) for r in entries]
        assert [x["source"] for x in shown] == ["a", "c", "b"]
        assert list(shown[0]) == SN.FIELDS["active_errors"]
        assert shown[0]["detail"] == 'naïve "x"' and shown[2]["detail"] is None
        assert shown[2]["last_error_display"] == "1970-01-01 00:00:10"


def test_service_summary_is_an_object(spark):
    latest = spark.createDataFrame([("lever", "ok", 3600, 5, '{"empty": 2, "ok": 7}')],
                                   "service string, status string, last_cycle_ts long, cycle_duration_ms long, summary_json string")
    (row,) = SN.services(latest).collect()
    assert json.loads(row.row) == {"service": "lever", "status": "ok", "last_cycle_ts": 3600, "cycle_duration_ms": 5,
                                   "summary": {"empty": 2, "ok": 7}, "last_cycle_display": "1970-01-01 01:00:00"}


def test_no_data_gives_zero_totals_and_no_lists(spark):
    jobs = spark.createDataFrame([], "provider string, external_job_id string, content_hash string, company string, title string, url string, location string")
    cls = spark.createDataFrame([], "provider string, external_job_id string, content_hash string, model string, role_type string, seniority string, "
                                    "location_fit string, relevance_score int, confidence double, reason string, classified_ts long")
    out = {r.part: r.row for r in SN.intelligence(cls, cls, jobs, 75, 20).collect()}
    assert out == {"total_jobs": "0", "classified_jobs": "0", "high_relevance_jobs": "0"}
    assert SN.latest_sources(spark.createDataFrame([], STATUS)).count() == 0
