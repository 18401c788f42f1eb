"""Split of classifier payloads, decoded summaries, the known-board table and board headers."""

import pytest

from jobsignal import rules as R
from jobsignal.operators import alerts as A
from jobsignal.operators import discover as D
from jobsignal.operators import health as H
from jobsignal.operators import store as S

GOOD = ("backend", R.ROLE_TYPES[0], "mid", "us_remote", 80, 0.5, "fits")
NAMES = ["role_family", "role_type", "seniority", "location_fit", "relevance_score", "confidence", "reason"]
SCHEMA = "id int, role_family string, role_type string, seniority string, location_fit string, relevance_score int, confidence double, reason string"


def test_first_failed_check_is_the_problem(spark):
    good = dict(zip(NAMES, (R.ROLE_FAMILIES[0], *GOOD[1:])))
    cases = [({}, None), ({"role_family": " x "}, "invalid role_family: x"), ({"role_family": None, "seniority": "x"}, "invalid role_family: "),
             ({"role_type": ""}, "invalid role_type: "), ({"seniority": "lead"}, "invalid seniority: lead"),
             ({"location_fit": None}, "invalid location_fit: "), ({"reason": " \t"}, "missing reason"), ({"reason": None, "relevance_score": 101}, "missing reason"),
             ({"relevance_score": None, "confidence": None}, "missing relevance_score"), ({"confidence": None, "relevance_score": 101}, "missing confidence"),
             ({"relevance_score": 101}, "relevance_score must be between 0 and 100"), ({"relevance_score": -1}, "relevance_score must be between 0 and 100"),
             ({"confidence": 1.01}, "confidence must be between 0 and 1"), ({"confidence": 0.0, "relevance_score": 100}, None),
             ({"reason": " " + "r" * 600}, None)]
    rows = [(i, *({**good, **change}[n] for n in NAMES)) for i, (change, _) in enumerate(cases)]
    valid, rejected = S.split_classifications(spark.createDataFrame(rows, SCHEMA))
    assert {r.id: r.problem for r in rejected.collect()} == {i: p for i, (_, p) in enumerate(cases) if p}
    kept = {r.id: r.reason for r in valid.collect()}
    assert sorted(kept) == [i for i, (_, p) in enumerate(cases) if not p]
    assert kept[14] == "r" * R.REASON_LIMIT


def test_summaries_survive_the_round_trip(spark):
    cycles = spark.createDataFrame([("lever", 60, 'o"k\\', 3, 5), ("lever", 60, "http_500", 0, 5), ("ashby", 60, "naïve 🙂", 2, 5)],
                                   "service string, cycle_ts long, status string, n long, duration_ms long")
    out = {tuple(r) for r in H.summary_entries(H.cycle_rollup(cycles)).collect()}
    assert out == {("lever", 60, 'o"k\\', 3), ("lever", 60, "http_500", 0), ("ashby", 60, "naïve 🙂", 2)}
    broken = spark.createDataFrame([("lever", 60, "{"), ("lever", 61, None)], "service string, last_cycle_ts long, summary_json string")
    assert H.summary_entries(broken).count() == 0


def test_a_harvest_run_again_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "boards")
    found = spark.createDataFrame([("lever", "a"), ("lever", "a"), ("ashby", "b")], "platform string, base string")
    for _ in range(2):
        D.append_boards(D.new_boards(found, D.read_known_boards(spark, path)), path)
    assert sorted(map(tuple, D.read_known_boards(spark, path).collect())) == [("ashby", "b"), ("lever", "a")]


@pytest.mark.parametrize("provider,header", [("ashby", "[acme]"), ("greenhouse", "Board: https://boards.greenhouse.io/acme"),
                                             ("lever", "Board: https://jobs.lever.co/acme")])
def test_classified_message_header_and_limit(spark, provider, header):
    rows = [(i, provider, "acme", f"t{i}", "r", "mid", "unclear", "", 60 + i % 3, "why", "") for i in range(7)]
    entries = spark.createDataFrame(rows, "doc_id int, provider string, company string, title string, role_type string, seniority string, "
                                          "location_fit string, location string, relevance_score int, reason string, url string")
    (message,) = [r.message for r in A.classified_messages(entries, 4).collect()]
    lines = message.split("\n")
    assert lines[0] == header and lines[2] == "r | mid | unclear | Unknown location" and len(lines) == 1 + 4 * 3
    assert [x for x in lines if "/100" in x] == ["62/100 | acme | t2", "62/100 | acme | t5", "61/100 | acme | t1", "61/100 | acme | t4"]
