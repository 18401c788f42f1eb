"""Streaming queries: each runs a Structured Streaming job to completion
(``availableNow``) over landed slices derived from the given tables and returns
the resulting state.  The oracle is the one-shot SQL: batch == stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsignal.operators import series as Z
from jobsignal.plans import alerts as PA
from jobsignal.plans import health as PH
from jobsignal.plans import sources as PR
from jobsignal.plans import store as PS
from jobsignal.plans.registry import QUERIES, register
from jobsignal.sources import landed as L
from jobsignal.sources.testdata import v_status_log, with_views
from jobsignal.streaming import ingest as I
from jobsignal.streaming import pipeline as SP
from jobsignal.streaming import windows as SW

YEAR_CUTS = [820454400, 852076800, 883612800, 915148800, 946684800]   # 1996..2000-01-01
WEEK_CUTS = [1704067200 + k * 7 * 86400 for k in (1, 2, 3, 4)]        # weekly, January 2024
LOOKBACK = 6 * 3600


def _late_copies(v):
    """A replay of old observations that arrives after newer ones."""
    newer = v.where(F.col("observed_ts") >= 852076800).select("provider", "external_job_id").distinct()
    old = v.where(F.col("observed_ts") < YEAR_CUTS[0]).join(newer, ["provider", "external_job_id"], "left_semi")
    return old.withColumn("seq", F.col("seq") + F.lit(10 ** 12))


@register("stream_job_upsert", ids="R2 R9 W4-W6", sql=lambda: QUERIES["job_upsert"].oracle())
def stream_job_upsert(spark, sf):
    v = PS.versions(spark, sf)
    jobs, _ = SP.job_upsert_stream(spark, v, YEAR_CUTS, late=_late_copies(v))
    return jobs


@register("late_rows", ids="R9", sql=lambda: with_views(["v_versions"], f"""SELECT seq + 1000000000000 AS seq, provider, external_job_id, observed_ts
    FROM v_versions v WHERE observed_ts < {YEAR_CUTS[0]} AND EXISTS (SELECT 1 FROM v_versions n WHERE n.provider = v.provider
    AND n.external_job_id = v.external_job_id AND n.observed_ts >= 852076800)"""))
def late_rows(spark, sf):
    v = PS.versions(spark, sf)
    _, late = SP.job_upsert_stream(spark, v, YEAR_CUTS, late=_late_copies(v))
    return late.select("seq", "provider", "external_job_id", "observed_ts")


@register("stream_source_status", ids="R5 W1-W3", sql=lambda: QUERIES["source_status_latest"].oracle())
def stream_source_status(spark, sf):
    status, _ = SP.health_stream(spark, v_status_log(spark, sf), WEEK_CUTS)
    return status


@register("stream_source_events", ids="R6 W2", sql=lambda: QUERIES["source_change_events"].oracle())
def stream_source_events(spark, sf):
    _, events = SP.health_stream(spark, v_status_log(spark, sf), WEEK_CUTS)
    return events


@register("stream_event_retention", ids="R6 T8", sql=lambda: QUERIES["event_retention"].oracle())
def stream_event_retention(spark, sf):
    """The newest events as the stream leaves them."""
    return SP.health_state(spark, v_status_log(spark, sf), WEEK_CUTS).read("retained")


@register("stream_first_alerts", ids="R4 W12",
          sql=lambda: PA.asql("SELECT service, source, external_job_id, first_alert_ts, seq, title FROM fa", "fa"))
def stream_first_alerts(spark, sf):
    out = SP.first_alerts_stream(spark, PA.observations(spark, sf), YEAR_CUTS)
    return out.select("service", "source", "external_job_id", "first_alert_ts", "seq", "title")


# --- R1: landed responses to alerts -------------------------------------------------------

FIRST_SQL = (f"SELECT provider AS service, company AS source, {PR.EXT_ID} AS external_job_id, seq * {I.PER_RESPONSE} + pos AS seq, ts AS first_alert_ts, "
             "title, location, CASE WHEN provider = 'lever' AND doc_id % 4 <> 0 THEN url ELSE '' END AS url, doc_id * 1000 AS updated_ms FROM ("
             f"SELECT *, row_number() OVER (PARTITION BY provider, company, doc_id ORDER BY seq) AS _first FROM okp WHERE {PR._MATCH_SQL}) x WHERE _first = 1")


#: ids of all providers meet here, so only numeric ones are ordered as numbers
_INGEST_LINES_SQL = PA._MSG_LINES_SQL.replace("CAST(external_job_id AS BIGINT)", "TRY_CAST(external_job_id AS BIGINT)")


def _ingest(spark, sf):
    """All landed responses in three micro-batches."""
    landed = L.landed_responses(spark, sf)
    end = landed.agg(F.max("fetched_ts")).first()[0] or L.FETCH_BASE_TS
    return SP.ingest_stream(spark, landed, [L.FETCH_BASE_TS + (end - L.FETCH_BASE_TS) * k // 3 for k in (1, 2)])


def _okp_sql(body: str, *more) -> str:
    return with_views(["v_postings"], body, [("pp", PR.PP), ("resp", PR.RESP), ("okp", PR.OKP), *more])


@register("stream_ingest", ids="R1 S14 W12 W13", sql=lambda: _okp_sql(f"""SELECT service, source, cycle_ts, generate_subscripts(chunks, 1) AS chunk_no, unnest(chunks) AS text
    FROM (SELECT service, source, cycle_ts, {PA._chunk_sql('lines')} AS chunks FROM ({_INGEST_LINES_SQL}) y) x""", ("fa", FIRST_SQL)))
def stream_ingest(spark, sf):
    """Alert messages of the whole stream."""
    return _ingest(spark, sf).read("alerts")


@register("stream_ingest_jobs", ids="R1 R2 R3", sql=lambda: _okp_sql(f"""SELECT n.provider, n.company, n.external_job_id, n.title, n.location, n.url,
    {PR.X.sql.content_hash('n.company', 'n.title', 'n.location', 'n.url', 'n.description')} AS content_hash, r.ts AS first_seen_ts, r.ts AS last_seen_ts, true AS classified
    FROM (SELECT *, row_number() OVER (PARTITION BY provider, external_job_id ORDER BY seq) AS _first FROM ({PR._norm_sql()}) q) n
    JOIN (SELECT DISTINCT seq, ts FROM resp) r ON r.seq = n.seq WHERE _first = 1"""))
def stream_ingest_jobs(spark, sf):
    """The job table after the whole stream, and whether each current content is classified."""
    state = _ingest(spark, sf)
    done = state.read("classifications").select("provider", "external_job_id", "content_hash", F.lit(True).alias("classified"))
    jobs = state.read("jobs").select("provider", "company", "external_job_id", "title", "location", "url", "content_hash", "first_seen_ts", "last_seen_ts")
    return jobs.join(done, ["provider", "external_job_id", "content_hash"], "left").withColumn("classified", F.coalesce("classified", F.lit(False)))


@register("stream_ingest_outcomes", ids="R1 A19 P13",
          sql=lambda: PR.psql(f"SELECT seq, service, source, ts AS fetched_ts, status, postings, new_matches, detail FROM ({PR.BOARD_RESULT_SQL}) b"))
def stream_ingest_outcomes(spark, sf):
    """The outcome log after the whole stream."""
    return _ingest(spark, sf).read("outcomes")


# --- R8/A17: scrapes of the last known state ------------------------------------------------

# from the definition: every scrape sees, of every board, the outcome that no later one before the scrape replaces
_SERIES_SQL = f"""SELECT service, tick, count(*) AS boards, CAST(sum(is_error) AS BIGINT) AS errors, CAST(sum(is_error) AS DOUBLE) / count(*) AS error_ratio
    FROM (SELECT unnest(generate_series((SELECT min(a) FROM held), (SELECT max(a) FROM held), {Z.STEP})) AS tick) k
    JOIN held ON held.a <= tick AND (held.z IS NULL OR tick < held.z) GROUP BY service, tick"""
_HELD_SQL = f"""SELECT service, is_error, (checked_ts + {Z.STEP - 1}) // {Z.STEP} * {Z.STEP} AS a,
    lead((checked_ts + {Z.STEP - 1}) // {Z.STEP} * {Z.STEP}) OVER (PARTITION BY service, source ORDER BY checked_ts, seq) AS z FROM f"""


def _series_sql(body: str) -> str:
    return with_views(["v_status_log"], body, [("f", PH.CTES["f"]), ("held", _HELD_SQL), ("series", _SERIES_SQL)])


@register("metric_series", ids="R8", sql=lambda: _series_sql("SELECT * FROM series"))
def metric_series(spark, sf):
    return Z.scrape_series(v_status_log(spark, sf))


@register("series_last_and_max", ids="A17", sql=lambda: _series_sql(f"""SELECT service, arg_max(errors, tick) AS last_errors, arg_max(error_ratio, tick) AS last_error_ratio,
    max(errors) AS max_errors, max(error_ratio) AS max_error_ratio FROM series WHERE tick >= (SELECT max(tick) FROM series) - {LOOKBACK} GROUP BY service"""))
def series_last_and_max(spark, sf):
    return Z.last_and_max(Z.scrape_series(v_status_log(spark, sf)), LOOKBACK)


# --- R7: cycle history ------------------------------------------------------------------------


@register("stream_cycle_history", ids="R7 T9 S12", sql=lambda: QUERIES["cycle_retention"].oracle())
def stream_cycle_history(spark, sf):
    """The newest cycles kept over micro-batches; every 50th poll of the first week lands last."""
    log = v_status_log(spark, sf)
    late = (F.col("checked_ts") < WEEK_CUTS[0]) & (F.col("seq") % 50 == 0)
    history = SP.cycle_history_stream(spark, log.where(~late), WEEK_CUTS, log.where(late))
    return history.select("service", "last_cycle_ts", "status")


# --- R9/R4: watermark and TTL -------------------------------------------------------------------

DAY = 86400


def _late_polls():
    """Every 50th poll of the first week, landing after all others."""
    return (F.col("checked_ts") < WEEK_CUTS[0]) & (F.col("seq") % 50 == 0)


_LATE_SQL = f"checked_ts < {WEEK_CUTS[0]} AND seq % 50 = 0"
_CLOSED_SQL = f"(SELECT max(checked_ts) FROM v_status_log WHERE NOT ({_LATE_SQL})) - {DAY}"


@register("stream_poll_windows", ids="R9", sql=lambda: with_views(["v_status_log"], f"""SELECT service, status, checked_ts - checked_ts % 3600 AS window_start, count(*) AS polls
    FROM v_status_log WHERE NOT ({_LATE_SQL}) AND checked_ts - checked_ts % 3600 + 3600 <= {_CLOSED_SQL} GROUP BY ALL"""))
def stream_poll_windows(spark, sf):
    """Polls per service, status and closed hour; what comes behind the watermark of a day changes nothing."""
    log = v_status_log(spark, sf)
    return SW.poll_windows_stream(spark, log.where(~_late_polls()), WEEK_CUTS, log.where(_late_polls()))[0]


@register("stream_late_polls", ids="R9", sql=lambda: with_views(["v_status_log"], f"""SELECT seq, service, source, checked_ts, {len(WEEK_CUTS) + 1} AS batch
    FROM v_status_log WHERE {_LATE_SQL} AND checked_ts - checked_ts % 3600 + 3600 <= {_CLOSED_SQL}"""))
def stream_late_polls(spark, sf):
    """The polls behind the watermark, with the micro-batch that brought them."""
    log = v_status_log(spark, sf)
    late = SW.poll_windows_stream(spark, log.where(~_late_polls()), WEEK_CUTS, log.where(_late_polls()))[1]
    return late.select("seq", "service", "source", "checked_ts", "batch")


@register("stream_alerts_ttl", ids="R4 W12",
          sql=lambda: PA.asql("SELECT service, source, external_job_id, first_alert_ts, seq, title FROM fa", "fa"))
def stream_alerts_ttl(spark, sf):
    """Alerts once per ten years, longer than the tables reach, so as if once for ever."""
    out = SW.alerts_ttl_stream(spark, PA.observations(spark, sf), YEAR_CUTS, 3650 * DAY)
    return out.select("service", "source", "external_job_id", "first_alert_ts", "seq", "title")
