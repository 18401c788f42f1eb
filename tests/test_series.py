"""R8/A17 against a scrape by scrape simulation, R7 against the batch history for any split, W11 over several runs."""

import random

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.operators import discover as D
from jobsignal.operators import health as H
from jobsignal.operators import series as Z
from jobsignal.streaming import pipeline as SP
from tests.test_search_yield import simulate

LOG = "seq long, service string, source string, status string, detail string, checked_ts long"


def log_rows(n, seed, span=200_000):
    r = random.Random(seed)
    return [(i, r.choice(["ashby", "lever"]), f"b{r.randrange(6)}", r.choice(["ok", "timeout", "new match", "error HTTP 500"]), None, 86_300 + r.randrange(span)) for i in range(n)]


def test_every_scrape_sees_the_last_state_of_all_boards(spark):
    rows = log_rows(120, 3, 4000) + [(500, "ashby", "b9", "timeout", None, 86_405), (501, "ashby", "b9", "ok", None, 86_405), (502, "late", "x", "timeout", None, 90_000)]
    df = spark.createDataFrame(rows, LOG)
    want, state = [], {}
    ordered = sorted(rows, key=lambda x: (x[5], x[0]))
    first, last = (-(-x // 15) * 15 for x in (ordered[0][5], ordered[-1][5]))
    for tick in range(first, last + 1, 15):
        for s, service, source, status, _, ts in ordered:
            if tick - 15 < ts <= tick:
                state[service, source] = status in ("timeout", "error HTTP 500")
        for service in {k[0] for k in state}:
            e = [v for k, v in state.items() if k[0] == service]
            want.append((service, tick, len(e), sum(e), sum(e) / len(e)))
    got = Z.scrape_series(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    recent = [w for w in want if w[1] >= last - 600]
    lm = {r.service: r for r in Z.last_and_max(Z.scrape_series(df), 600).collect()}
    for service in {w[0] for w in recent}:
        mine = [w for w in recent if w[0] == service]
        assert (lm[service].last_errors, lm[service].max_errors) == (mine[-1][3], max(w[3] for w in mine))
        assert lm[service].max_error_ratio == max(w[4] for w in mine)
    assert Z.scrape_series(df.limit(0)).count() == 0


def test_cycle_history_stream_equals_retention_for_any_split(spark):
    df = spark.createDataFrame(log_rows(400, 5), LOG)
    cycle = (F.col("checked_ts") - F.col("checked_ts") % 3600).alias("cycle_ts")
    g = df.groupBy("service", cycle, "status").agg(F.count("*").alias("n"))
    want = H.newest(H.cycle_rollup(g.withColumn("duration_ms", F.lit(0))), 20, F.desc("last_cycle_ts"), F.desc("service"))
    cols = ["service", "last_cycle_ts", "status", "summary_json", "error_count", "ok_count"]
    want = sorted(tuple(r) for r in want.select(*cols).collect())
    late = F.col("seq") % 7 == 0
    for cuts in ([], [120_000, 200_000], [100_000 + 20_000 * k for k in range(9)]):
        got = SP.cycle_history_stream(spark, df.where(~late), cuts, df.where(late), keep=20)
        assert sorted(tuple(r) for r in got.select(*cols).collect()) == want


def test_harvest_runs_are_independent_and_whole(spark):
    r = random.Random(8)
    hits = [(run, f"{p}.example.com", q, start, pos, f"https://{p}.example.com/s{r.randrange(25)}/x")
            for run in range(4) for p in "ab" for q in range(3) for start in range(0, 10 * r.randrange(1, 12), 10) for pos in range(r.randrange(1, 11))]
    df = spark.createDataFrame(hits, "run long, platform string, query_idx long, start long, pos long, link string")
    got = sorted(tuple(x) for x in D.search_yield(df, 3).select("run", "platform", "query_idx", "start", "new_boards", "discovered_total").collect())
    want = [(run, *x) for run in range(4) for x in simulate([h[1:] for h in hits if h[0] == run], 3)]
    assert got == sorted(want) and R.SEARCH_EMPTY_STREAK == 5


def test_every_page_is_a_hit_of_a_run(spark):
    from jobsignal.sources.testdata import v_search_hits

    hits = v_search_hits(spark, "/root/testdata/sf0.1")
    assert hits.count() == spark.read.parquet("/root/testdata/sf0.1/pages.parquet").count()
    assert hits.where(F.col("start") > R.SEARCH_MAX_START).count() == 0 and hits.select("run").distinct().count() == 2
