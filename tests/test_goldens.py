"""Goldens traced by hand from the original program (FIXTURES.md §1-2), quirks included."""

import hashlib
import json

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.operators import alerts as A
from jobsignal.operators import classify as C
from jobsignal.operators import health as H
from jobsignal.operators import store as S

SMOKE = {
    "provider": "greenhouse", "company": "example-ai", "external_job_id": "smoke-123",
    "title": "Software Engineer, New Grad - Backend Platform", "location": "Remote - United States",
    "url": "https://boards.greenhouse.io/example/jobs/smoke-123",
    "description": ("Build Python APIs and distributed backend services for an AI product. "
                    "This role is intended for new graduates and early-career engineers."),
}


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_smoke_job_classification(spark):
    df = spark.createDataFrame([SMOKE])
    r = C.classify(df).collect()[0]
    assert (r.role_family, r.family_score) == ("software_engineering", 8)
    assert (r.role_type, r.type_score) == ("backend", 5)
    assert (r.seniority, r.seniority_score) == ("new_grad", 3)
    assert r.location_fit == "us_remote"
    assert r.relevance_score == 100 and r.confidence == 0.98
    assert r.reason == ("Local classifier scored this as software_engineering/backend, seniority=new_grad, "
                        "location_fit=us_remote; score=100, confidence=0.98.")


def test_smoke_job_hash_and_upsert(spark):
    df = spark.createDataFrame([{**SMOKE, "seq": 1, "observed_ts": 0, "raw_json": '{"id": "smoke-123"}'}])
    h = S.with_hash(df).collect()[0].content_hash
    blob = json.dumps({k: SMOKE[k] for k in ("company", "title", "location", "url", "description")},
                      sort_keys=True, separators=(",", ":")).encode()
    assert h == hashlib.sha256(blob).hexdigest() == "6e7c2a9c7dc7f734e13373ab3f731202c9a42d9b943dde57508d90c40c854fb0"
    feed = S.change_feed(df).collect()[0]
    assert feed.is_new and feed.changed


def test_classifier_rows(spark):
    rows = [("Senior Software Engineer", "London, United Kingdom"), ("Backend Engineer II", "Remote"),
            ("Product Manager", "San Francisco, CA")]
    df = spark.createDataFrame([(t, l, "") for t, l in rows], "title string, location string, description string")
    got = [(r.role_family, r.family_score, r.role_type, r.type_score, r.seniority, r.location_fit, r.relevance_score, r.confidence)
           for r in C.classify(df).collect()]
    assert got == [
        ("software_engineering", 4, "other", 0, "senior", "non_us", 0, 0.75),
        ("software_engineering", 4, "backend", 4, "mid", "unclear", 75, 0.89),
        ("product", 4, "other", 0, "manager", "us_onsite", 0, 0.75),
    ]


def test_title_match(spark):
    cases = {"Software Engineer, New Grad - Backend Platform": True, "Backend Engineer": True, "Front-End Developer": True,
             "Senior Software Engineer": False, "Software Engineer, Infrastructure": False, "Data Engineer": False,
             "Engineer, Web Platform": False, "Product Engineer": False}
    df = one_col(spark, list(cases), "title").select("title", P.title_matches(F.col("title")).alias("m"))
    assert {r.title: r.m for r in df.collect()} == cases


def test_us_location_monitor_rules(spark):
    cases = {"Remote, US": True, "San Francisco, CA": True, "Berlin, DE": True, "Remote in Germany": True,
             "Tbilisi, Georgia": True, "Toronto, ON, CA": True, "Paris, Île-de-France": True, "US": False,
             "D.C.": False, "Remote": False, "London, United Kingdom": False, "Toronto, ON, Canada": False, "": False}
    df = one_col(spark, list(cases), "loc").select("loc", P.is_us_location(F.col("loc")).alias("m"))
    assert {r.loc: r.m for r in df.collect()} == cases


def test_location_fit(spark):
    cases = {"": "unclear", "Remote - United States": "us_remote", "Remote (US)": "us_remote", "US": "us_onsite",
             "Hybrid - New York, NY": "hybrid_us", "Indianapolis, IN": "us_onsite", "Milwaukee": "non_us",
             "Remote, Canada": "non_us", "London, UK or Remote": "us_remote", "Dublin, CA": "us_onsite",
             "Remote - Worldwide": "unclear", "Berlin, DE": "us_onsite"}
    df = one_col(spark, list(cases), "loc").select("loc", C.location_fit(X.norm_text(F.col("loc"))).alias("fit"))
    assert {r.loc: r.fit for r in df.collect()} == cases


def test_strip_html_and_join_text(spark):
    df = one_col(spark, ["<p>Hello<br/>world</p><b>!</b>", "&lt;p&gt;x", None])
    assert [r.t for r in df.select(X.strip_html(F.col("v")).alias("t")).collect()] == ["Hello world !", "&lt;p&gt;x", ""]
    j = spark.range(1).select(X.join_text(F.array(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit(None).cast("string"), F.lit("")), ", ").alias("j"))
    assert j.collect()[0].j == "a, b"


def test_unicode_title_normalisation(spark):
    df = one_col(spark, ["Développeur  Backend Engineer!"]).select(X.normalize_title(F.col("v")).alias("t"))
    assert df.collect()[0].t == "développeur backend engineer"


def test_slugs(spark):
    ashby = {"https://jobs.ashbyhq.com/Acme%20AI/1": "acme-ai", "AT&T Careers Page": "atandt", "foo__bar": "foo-bar",
             "jobs.ashbyhq.com/foo": "jobsashbyhqcomfoo"}
    df = one_col(spark, list(ashby)).select("v", X.slugify_ashby(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == ashby
    gh = one_col(spark, ["acme/", "boards.greenhouse.io/acme/jobs/1"]).select(X.greenhouse_slug(F.col("v")).alias("s"))
    assert [r.s for r in gh.collect()] == ["acme", "acme"]
    lv = one_col(spark, ["https://jobs.lever.co/zoox/apply", "jobs.lever.co/"]).select(X.lever_slug(F.col("v")).alias("s"))
    assert [r.s for r in lv.collect()] == ["zoox", None]
    links = spark.createDataFrame([("https://Boards.Greenhouse.io/Acme/jobs/1", "boards.greenhouse.io"),
                                   ("https://jobs.lever.co/search", "jobs.lever.co")], "link string, host string")
    assert [r.s for r in links.select(X.extract_slug(F.col("link"), F.col("host")).alias("s")).collect()] == ["Acme", None]


def test_error_status_and_badge(spark):
    df = one_col(spark, ["", None, "OK ", "unchanged (304)", "http_404", "task_exception:X"])
    got = [(r.e, r.b) for r in df.select(P.is_error_status(F.col("v")).alias("e"), X.status_badge(F.col("v")).alias("b")).collect()]
    assert [g[0] for g in got] == [True, True, False, False, True, True]
    assert got[5][1] == "ok" and got[4][1] == "error"


def test_upsert_throttle_golden(spark):
    rows = [(1, 0, "h1"), (2, 100, "h1"), (3, 21600, "h1"), (4, 21700, "h2"), (5, 30000, "h1")]
    df = spark.createDataFrame([(s, "greenhouse", "k", "co", "t", "", "", d, ts, "{}") for s, ts, d in rows],
                               "seq long, provider string, external_job_id string, company string, title string, location string, url string, description string, observed_ts long, raw_json string")
    feed = S.change_feed(df).orderBy("seq").collect()
    assert [(r.is_new, r.changed) for r in feed] == [(True, True), (False, False), (False, False), (False, True), (False, True)]
    # last_seen after each prefix of the history
    seen = []
    for n in range(1, 6):
        j = S.upsert(df.where(F.col("seq") <= n)).collect()[0]
        seen.append((j.first_seen_ts, j.last_seen_ts))
    assert seen == [(0, 0), (0, 0), (0, 21600), (0, 21700), (0, 30000)]
    # incremental application equals one shot
    state = S.upsert(df.where(F.col("seq") <= 2))
    inc = S.upsert(df.where(F.col("seq") > 2), state=state).collect()[0]
    assert (inc.first_seen_ts, inc.last_seen_ts, inc.description) == (0, 30000, "h1")


def test_health_golden(spark):
    statuses = ["ok", "ok", "error HTTP 500", "error HTTP 500", "timeout", "ok"]
    df = spark.createDataFrame([(i, "greenhouse", "b", s, "same", i * 10) for i, s in enumerate(statuses)],
                               "seq long, service string, source string, status string, detail string, checked_ts long")
    assert [r.consecutive_errors for r in H.consecutive_errors(df).orderBy("seq").collect()] == [0, 0, 1, 2, 3, 0]
    emitted = {r.seq for r in H.change_events(df).collect()}
    assert [i in emitted for i in range(6)] == [True, False, True, True, True, True]
    st = H.source_status(df.where(F.col("seq") <= 4)).collect()[0]
    assert (st.consecutive_errors, st.last_ok_ts, st.last_error_ts, st.is_error) == (3, 10, 40, 1)


def test_chunking_golden(spark):
    df = spark.createDataFrame([(["aa", "bbb", "c", "dddddddd", "e"],)], "lines array<string>")
    got = df.select(A.chunk_lines(F.col("lines"), 6).alias("c")).collect()[0].c
    assert got == ["aa\nbbb", "c", "dddddddd", "e"]


def test_threshold_clamp():
    assert R.clamp_threshold("150") == 100 and R.clamp_threshold("-3") == 0 and R.clamp_threshold("x") == 75


def test_failure_isolation_retries_classification(spark):
    """The raw job is saved first; with no classification stored (a failed
    classifier run), the next pass sees a cache miss and classifies it."""
    df = spark.createDataFrame([{**SMOKE, "seq": 1, "observed_ts": 0, "raw_json": "{}"}])
    jobs = S.upsert(df)
    assert jobs.count() == 1
    batch = S.with_hash(df).select(*S.KEY, "content_hash", *S.ATTRS, "observed_ts")
    empty_cache = spark.createDataFrame([], "provider string, external_job_id string, content_hash string, model string")
    hits, misses = S.cache_split(batch, empty_cache, R.DEFAULT_MODEL)
    assert hits.count() == 0 and misses.count() == 1
    cls = S.classify_if_needed(batch, S.to_classification_rows(C.classify(batch.withColumn("classified_ts", F.lit(5)))).limit(0))
    row = cls.collect()[0]
    assert row.cache_hit is False and row.relevance_score == 100
    again = S.classify_if_needed(batch, S.to_classification_rows(C.classify(batch.withColumn("classified_ts", F.lit(5))))).collect()[0]
    assert again.cache_hit is True


def test_board_state_golden(spark):
    """A 200 replaces etag even with null; 304 / 5xx / timeout keep it; last_seen always moves."""
    from jobsignal.operators import normalize as N

    rows = [(1, 200, None, 'W/"a"', 10, '{"jobs":[]}'), (2, 200, None, None, 20, '{"jobs":[]}'),
            (3, 304, None, None, 30, None), (4, 500, None, None, 40, None), (5, None, "timeout", None, 50, None)]
    df = spark.createDataFrame([(s, "greenhouse", "acme", c, k, None, e, None, t, b) for s, c, k, e, t, b in rows],
                               "seq long, service string, source string, http_status int, error_kind string, error_message string, "
                               "etag string, last_modified string, fetched_ts long, body string")
    st = N.board_state(df.where("seq <= 1")).collect()[0]
    assert (st.etag, st.last_seen_ts) == ('W/"a"', 10)
    st = N.board_state(df).collect()[0]
    assert (st.etag, st.last_seen_ts) == (None, 50)
    statuses = [r.status for r in N.poll_status(df).orderBy("seq").collect()]
    assert statuses == ["ok", "ok", "unchanged (304)", "error HTTP 500", "timeout"]


def test_stream_equals_batch_small(spark):
    """Micro-batch application equals the one-shot result (sf0.001)."""
    from jobsignal.plans import store as PS
    from jobsignal.operators import health as H
    from jobsignal.sources.testdata import v_status_log
    from jobsignal.streaming import pipeline as SP

    sf = "/root/testdata/sf0.001"
    v = PS.versions(spark, sf)
    jobs, _ = SP.job_upsert_stream(spark, v, [852076800, 915148800])
    one_shot = S.upsert(v)
    assert jobs.exceptAll(one_shot).count() == 0 and one_shot.exceptAll(jobs).count() == 0
    log = v_status_log(spark, sf)
    status, _ = SP.health_stream(spark, log, [1704067200 + 10 * 86400, 1704067200 + 20 * 86400])
    batch = H.source_status(log)
    assert status.exceptAll(batch).count() == 0 and batch.exceptAll(status).count() == 0


def test_health_carries_across_buckets(spark):
    """W1/W2 two-level form: the same answers when every row sits in its own bucket."""
    statuses = ["ok", "ok", "error HTTP 500", "error HTTP 500", "timeout", "ok", "timeout", "timeout"]
    df = spark.createDataFrame([(i, "greenhouse", "b", s, "same", i * 10) for i, s in enumerate(statuses)],
                               "seq long, service string, source string, status string, detail string, checked_ts long")
    for bucket in (1, 15, 25, 1000):
        got = [r.consecutive_errors for r in H.consecutive_errors(df, bucket).orderBy("seq").collect()]
        assert got == [0, 0, 1, 2, 3, 0, 1, 2], bucket
        emitted = sorted(r.seq for r in H.change_events(df, bucket).collect())
        assert emitted == [0, 2, 3, 4, 5, 6, 7], bucket


def test_skip_unchanged_is_304_only(spark):
    """A 200 is processed even with the fingerprint of the response before (a title may have changed)."""
    from jobsignal.operators import normalize as N

    a, b = '{"jobs":[{"id":1,"updated_at":"x"}]}', '{"jobs":[{"id":1,"updated_at":"y"}]}'
    rows = [(1, 200, a, 0), (2, 200, a, 10), (3, 500, None, 90000), (4, 200, a, 200000), (5, 200, b, 200010), (6, 304, None, 300000)]
    df = spark.createDataFrame([(s, "greenhouse", "acme", c, None, None, None, None, t, body) for s, c, body, t in rows],
                               "seq long, service string, source string, http_status int, error_kind string, error_message string, "
                               "etag string, last_modified string, fetched_ts long, body string")
    got = {r.seq: r.skip for r in N.skip_unchanged(df).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_throttle_distributed_equals_fold(spark):
    """W6 by blocks equals the plain fold, at every group size."""
    import random

    rnd = random.Random(11)
    rows, seq = [], 0
    for g in range(25):
        t = rnd.randint(0, 50000)
        for _ in range(rnd.randint(1, 40)):
            t += rnd.choice([0, 1, 100, 5000, 21599, 21600, 21601, 40000, 90000])
            seq += 1
            rows.append((f"k{g}", seq, t))
    df = spark.createDataFrame(rows, "k string, seq long, ts long")
    r = rnd
    got = {x.k: x._last for x in S.throttle(df.withColumn("_v", F.lit(1)), 21600, ["k"], "ts").collect()}
    want = {}
    for k in {x[0] for x in rows}:
        times = sorted(t for g, _, t in rows if g == k)
        last = times[0]
        for t in times:
            last = t if t - last >= 21600 else last
        want[k] = last
    assert got == want
    # out of order rows, a hot posting, and a stored row that is newer than part of the batch
    schema = ("seq long, provider string, external_job_id string, company string, title string, location string, "
              "url string, description string, observed_ts long, raw_json string")
    hot = [(i, "lever", "hot", "co", "t", "", "", "same", r.randint(0, 3_000_000), "{}") for i in range(3000)]
    late = [(9001, "lever", "p", "co", "t", "", "", "d", 90000, "{}"), (9002, "lever", "p", "co", "t", "", "", "d", 115000, "{}")]
    state = S.upsert(spark.createDataFrame([(1, "lever", "p", "co", "t", "", "", "d", 100000, "{}")], schema))
    out = {x.external_job_id: x for x in S.upsert(spark.createDataFrame(hot + late, schema), state).collect()}
    assert out["p"].first_seen_ts == 100000 and out["p"].last_seen_ts == 100000
    times = sorted(x[8] for x in hot)
    last = times[0]
    for t in times:
        last = t if t - last >= 21600 else last
    assert out["hot"].first_seen_ts == times[0] and out["hot"].last_seen_ts == last


def test_level_gate_and_alert_path_switch(spark):
    """F2 (off by default) and F16: relevance alerts when classification is on,
    deterministic title/location alerts when it is off."""
    from jobsignal.plans import alerts as PA

    df = one_col(spark, ["Software Engineer I", "Backend Engineer", "Software Developer Intern"], "title")
    gated = {r.title: r.m for r in df.select("title", P.title_matches(F.col("title"), level_gate=True).alias("m")).collect()}
    assert gated == {"Software Engineer I": True, "Backend Engineer": False, "Software Developer Intern": True}
    sf = "/root/testdata/sf0.001"
    on = PA.alert_candidates(spark, sf)
    off = PA.alert_candidates(spark, sf, R.Rules(classification_enabled=False))
    assert on.where("relevance_score < 75").count() == 0 and on.count() > 0
    from jobsignal.plans.registry import QUERIES

    det = QUERIES["deterministic_match"].build(spark, sf)
    assert off.count() == det.count() > 0


def test_known_boards_append(spark, tmp_path):
    """New boards are appended; a second run finds nothing new."""
    from jobsignal.operators import discover as D

    path = str(tmp_path / "known")
    found = spark.createDataFrame([("h", "https://h/a"), ("h", "https://h/b"), ("h", "https://h/a")], "platform string, base string")
    new = D.new_boards(found, D.read_known_boards(spark, path))
    assert new.count() == 2
    D.append_boards(new, path)
    assert D.new_boards(found, D.read_known_boards(spark, path)).count() == 0


def test_change_feed_two_level_equals_single(spark):
    """W4 two-level form (per posting and time bucket + bucket summaries) == one window."""
    from jobsignal.plans import store as PS

    v = PS.versions(spark, "/root/testdata/sf0.001")
    cols = ["seq", "provider", "external_job_id", "is_new", "changed", "island"]
    one = S.change_feed(v, bucket_seconds=None).select(*cols)
    for bucket in (86400, 86400 * 365):
        two = S.change_feed(v, bucket_seconds=bucket).select(*cols)
        assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0, bucket
    state = S.upsert(v.where("observed_ts < 883612800"))
    batch = v.where("observed_ts >= 883612800")
    a = S.upsert(batch, state, bucket_seconds=None)
    b = S.upsert(batch, state)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    rows = [(1, 0, "h1"), (2, 100, "h1"), (3, 21600, "h1"), (4, 21700, "h2"), (5, 30000, "h1")]
    df = spark.createDataFrame([(s_, "greenhouse", "k", "co", "t", "", "", d, t, "{}") for s_, t, d in rows],
                               "seq long, provider string, external_job_id string, company string, title string, location string, url string, description string, observed_ts long, raw_json string")
    got = [(r.is_new, r.changed, r.island) for r in S.change_feed(df, bucket_seconds=50).orderBy("seq").collect()]
    assert got == [(True, True, 1), (False, False, 1), (False, False, 1), (False, True, 2), (False, True, 3)]


def test_board_polled_three_times_matches_once(spark):
    """A posting is a new match in the first response that holds it only."""
    from jobsignal.operators import normalize as N

    body = '{"jobs":[{"id":1,"title":"Software Engineer","location":{"name":"Austin, TX"}}]}'
    df = spark.createDataFrame([(s, "greenhouse", "acme", 200, None, None, None, None, 10 * s, body) for s in (1, 2, 3)],
                               "seq long, service string, source string, http_status int, error_kind string, error_message string, "
                               "etag string, last_modified string, fetched_ts long, body string")
    got = [(r.status, r.detail) for r in N.board_result(df).orderBy("seq").collect()]
    assert got == [("new match", "jobs=1 new_matches=1"), ("ok", "jobs=1 new_matches=0"), ("ok", "jobs=1 new_matches=0")]


def test_lever_without_id(spark):
    """Without an id the URL is the board's; a line needs a title and a URL only."""
    df = spark.createDataFrame([("lever", "acme", "Chef", "", None), ("lever", "acme", "Chef", None, "https://a/b"), ("lever", "acme", "Chef", "7", None)],
                               "service string, source string, title string, id string, apply string")
    cols = [F.col(c) for c in ("service", "source", "title", "id", "apply")]
    got = [r[0] for r in df.select(A.alert_line(*cols)).collect()]
    assert got == ["Chef | https://jobs.lever.co/acme", "Chef | https://a/b", "Chef | https://jobs.lever.co/acme/7"]


def test_summary_json_parses(spark):
    df = spark.createDataFrame([("s", 1, 'exception: a\nb "q" \\', 2, 5)], "service string, cycle_ts long, status string, n long, duration_ms long")
    assert json.loads(H.cycle_rollup(df).collect()[0].summary_json) == {'exception: a\nb "q" \\': 2}


def test_known_boards_errors_are_not_swallowed(spark, tmp_path):
    import pytest

    from jobsignal.operators import discover as D

    (tmp_path / "known").write_text("no parquet")
    with pytest.raises(Exception):
        D.read_known_boards(spark, str(tmp_path / "known")).count()


def test_late_poll_keeps_newer_status(spark):
    """A poll older than the stored check does not overwrite it."""
    from jobsignal.streaming import pipeline as SP

    schema = "seq long, service string, source string, status string, detail string, checked_ts long"
    state = H.source_status(spark.createDataFrame([(1, "lever", "acme", "ok", "", 1000)], schema))
    late = spark.createDataFrame([(2, "lever", "acme", "timeout", "", 500)], schema)
    r = SP.merge_status(state, late).collect()[0]
    assert (r.status, r.last_checked_ts, r.last_ok_ts, r.last_error_ts) == ("ok", 1000, 1000, 500)


def test_throttle_of_a_posting_seen_a_million_times(spark):
    """W6 and W5 stream a hot posting's times; contents alternate, a second holds two contents, batches split a group."""
    n = 1_000_000
    hot = spark.range(n).select(F.col("id").alias("seq"), F.lit("lever").alias("provider"), F.lit("hot").alias("external_job_id"), F.lit("co").alias("company"),
                                F.when(F.col("id") < 1000, F.lit("old")).otherwise(F.lit("new")).alias("title"), F.lit("").alias("location"),
                                F.lit("").alias("url"), F.lit("d").alias("description"), (F.col("id") * 61).alias("observed_ts"), F.lit("{}").alias("raw_json"))
    start = last = 1000 * 61
    while (nxt := -(-(last + 21600) // 61) * 61) < n * 61:
        last = nxt
    got = S.upsert(hot).collect()
    assert [(r.title, r.first_seen_ts, r.last_seen_ts) for r in got] == [("new", 0, last)] and start < last


def test_upsert_equals_the_change_feed_form(spark):
    import random

    r = random.Random(5)
    schema = ("seq long, provider string, external_job_id string, company string, title string, location string, "
              "url string, description string, observed_ts long, raw_json string")
    rows = [(i, "lever", f"p{r.randrange(12)}", "co", r.choice("ab"), "", "", f"d{r.randrange(2)}", r.choice([0, 7, 30000, 60000, r.randrange(200000)]), f"{{{i}}}") for i in range(400)]
    df = spark.createDataFrame(rows, schema)
    assert S.upsert(df).exceptAll(S.upsert(df, bucket_seconds=None)).count() == 0 and S.upsert(df).count() == 12
    state = S.upsert(df.where("seq < 200"))
    a, b = (S.upsert(df.where("seq >= 200"), state, bucket_seconds=x) for x in (None, S.BUCKET_SECONDS))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert S.upsert(df.limit(0)).count() == 0 and S.upsert(df.limit(0), state).exceptAll(state).count() == 0
