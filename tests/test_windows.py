"""Watermarked windows, late rows, alerts with a TTL and the retained events, against plain Python."""

import collections

from jobsignal.streaming import pipeline as SP
from jobsignal.streaming import windows as SW

LOG = "seq long, service string, source string, status string, detail string, checked_ts long"


def _log(spark, times, first=0):
    return spark.createDataFrame([(first + i, "ashby", "b", "ok" if i % 2 else "timeout", None, t) for i, t in enumerate(times)], LOG)


def test_every_poll_is_counted_once_open_or_late(spark):
    slices, late = [[5, 9, 10, 19], [31, 25, 22], [44, 58]], [39, 12, 52, 41, 7]
    closed, behind = SW.poll_windows_stream(spark, _log(spark, sum(slices, [])), [20, 40], _log(spark, late, 100), delay=8, window=10)
    got = {(r.status, r.window_start): r.polls for r in closed.collect()}
    gone = sorted((r.checked_ts, r.batch) for r in behind.collect())
    assert gone == [(7, 3), (12, 3), (39, 3), (41, 3)]  # the newest time before them is 58, so all that ends by 50 is closed
    rows = [("ok" if i % 2 else "timeout", t) for i, t in enumerate(sum(slices, []))]
    rows += [("ok" if i % 2 else "timeout", t) for i, t in enumerate(late) if (t, 3) not in gone]
    want = collections.Counter((s, t - t % 10) for s, t in rows if t - t % 10 + 10 <= 58 - 8)
    assert got == want


def test_nothing_is_late_or_closed_without_polls(spark):
    closed, behind = SW.poll_windows_stream(spark, _log(spark, [3]).limit(0), [20], delay=8, window=10)
    assert (closed is None or closed.count() == 0) and (behind is None or behind.count() == 0)


def test_an_alert_comes_again_after_its_ttl(spark):
    rows = [(1, "J", 100), (2, "J", 105), (3, "K", 110), (4, "J", 130), (5, "K", 400), (6, "J", 410), (7, "J", 415), (8, "K", 416)]
    obs = spark.createDataFrame([(s, "lever", "acme", i, "Software Engineer", "Remote (US)", t) for s, i, t in rows],
                                "seq long, service string, source string, external_job_id string, title string, location string, observed_ts long")
    cuts = [104, 120, 300, 405, 412]
    short = SW.alerts_ttl_stream(spark, obs, cuts, 50)
    # K at 400 is what moves the stream past the TTL, so its id is still known then and alerts with the next match
    assert sorted((r.external_job_id, r.first_alert_ts) for r in short.collect()) == [("J", 100), ("J", 410), ("K", 110), ("K", 416)]
    ever = SW.alerts_ttl_stream(spark, obs, cuts, 10_000)
    assert sorted((r.external_job_id, r.first_alert_ts) for r in ever.collect()) == [("J", 100), ("K", 110)]


def test_retained_events_do_not_depend_on_the_split(spark):
    log = spark.createDataFrame([(i, "ashby", f"b{i % 3}", "timeout" if i % 4 else "ok", str(i % 5), 10 * i) for i in range(40)], LOG)
    want = sorted(r.seq for r in SP.H.newest(SP.H.change_events(log), 7, SP.F.desc("seq")).collect())
    for cuts in ([], [95, 100, 380]):
        kept = SP.health_state(spark, log, cuts, keep=7).read("retained")
        assert sorted(r.seq for r in kept.collect()) == want
