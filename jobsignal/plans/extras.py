"""Remaining sources and reports: search pages, log lines, cycle totals,
notified-id lists, exposition text, dashboard document, in-stream classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import text as X
from jobsignal.functions.text import q
from jobsignal.operators import health as H
from jobsignal.operators import metrics as M
from jobsignal.operators import snapshot as SN
from jobsignal.plans import alerts as PA
from jobsignal.plans import health as PH
from jobsignal.plans import sources as PSRC
from jobsignal.plans import store as PS
from jobsignal.plans.registry import QUERIES, register
from jobsignal.sources import landed as L
from jobsignal.sources import logs as LG
from jobsignal.sources.testdata import provider_of, spread, table, v_search_hits, with_views
from jobsignal.streaming import pipeline as SP

# --- S5: search result pages ---------------------------------------------------------------


def search_pages(spark, sf):
    """Landed search responses {organic_results:[{link}]} per (run, platform, query, start)."""
    h = v_search_hits(spark, sf)
    g = h.groupBy("run", "platform", "query_idx", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("_r"))
    return g.select("run", "platform", "query_idx", "start", F.to_json(F.struct(
        F.transform("_r", lambda r: F.struct(r["link"].alias("link"))).alias("organic_results"))).alias("body"))


@register("src_search_results", ids="S5",
          sql=lambda: with_views(["v_search_hits"], "SELECT run, platform, query_idx, start, "
                                 "row_number() OVER (PARTITION BY run, platform, query_idx, start ORDER BY pos) - 1 AS pos, link FROM v_search_hits"))
def src_search_results(spark, sf):
    v = search_pages(spark, sf).withColumn("v", F.try_parse_json("body"))
    e = v.select("run", "platform", "query_idx", "start", F.posexplode(L.variant_list(F.col("v"), "$.organic_results")).alias("pos", "r"))
    return e.select("run", "platform", "query_idx", "start", F.col("pos").cast("long").alias("pos"),
                    F.coalesce(F.try_variant_get("r", "$.link", "string"), F.lit("")).alias("link"))


# --- S17 / X23: log lines -------------------------------------------------------------------------

_LINE = ("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || CAST(user_id AS VARCHAR) || ']' WHEN 2 THEN '   ' "
         "ELSE 'plain output ' || event_type || '  ' END")


def log_lines(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props"), "event_id")
    line = (F.when(F.col("event_id") % 4 == 0, F.col("props"))
            .when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
            .when(F.col("event_id") % 4 == 2, F.lit("   "))
            .otherwise(F.concat(F.lit("plain output "), F.col("event_type"), F.lit("  "))))
    return e.select(F.col("event_id").alias("seq"), "ts", "user_id", line.alias("line"))


def _iso_sql(ts: str) -> str:
    return (f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END")


@register("src_log_lines", ids="S17 X23",
          sql=lambda: f"""SELECT seq, CASE WHEN is_obj THEN 'passthrough' ELSE 'wrapped' END AS kind,
              CASE WHEN is_obj THEN text ELSE
                CAST(json_object('timestamp', {_iso_sql('ts')}, 'level', 'INFO', 'service', 'supervisor', 'event', 'subprocess_output',
                                 'child_service', 'child-' || CAST(user_id % 3 AS VARCHAR), 'message', text) AS VARCHAR) END AS out
              FROM (SELECT *, CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END AS is_obj FROM
                    (SELECT event_id AS seq, ts, user_id, rtrim({_LINE}) AS text FROM events) x0) x WHERE text <> ''""")
def src_log_lines(spark, sf):
    lines = log_lines(spark, sf)
    return LG.triage(lines, F.concat(F.lit("child-"), (F.col("user_id") % 3).cast("string")))


@register("log_rows", ids="X23",
          sql=lambda: f"""SELECT event_id AS seq, CAST(json_object('timestamp', {_iso_sql('ts')}, 'level', 'INFO', 'service', 'tracker',
              'event', event_type, 'field_service', CASE user_id % 3 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' ELSE 'lever' END,
              'user_id', user_id) AS VARCHAR) AS row FROM events""")
def log_rows(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), "event_id")
    row = LG.log_row(F.col("ts"), "INFO", F.lit("tracker"), F.col("event_type"),
                     [("service", provider_of(F.col("user_id"))), ("user_id", F.col("user_id")),
                      ("note", F.lit(None).cast("string"))])
    return e.select(F.col("event_id").alias("seq"), row.alias("row"))


# --- A8: cycle totals --------------------------------------------------------------------------------


@register("cycle_totals", ids="A8 A19",
          sql=lambda: PSRC.psql(f"""SELECT service, ts - ts % 3600 AS cycle_ts, CAST(sum(postings) AS BIGINT) AS total_postings,
              CAST(sum(new_matches) AS BIGINT) AS total_new_matches FROM ({PSRC.BOARD_RESULT_SQL}) b GROUP BY ALL"""))
def cycle_totals(spark, sf):
    br = PSRC._board_result(spark, sf)
    return br.groupBy("service", (F.col("fetched_ts") - F.col("fetched_ts") % 3600).alias("cycle_ts")).agg(
        F.sum("postings").cast("long").alias("total_postings"), F.sum("new_matches").cast("long").alias("total_new_matches"))


# --- X18: exposition text ---------------------------------------------------------------------------

_HELP_VALUES = ", ".join(f"({q(M.PREFIX + n)}, {q(d)})" for n, d in M.HELP)


@register("exposition_text", ids="S16 X17 X18",
          sql=lambda: PH.hsql(f"""SELECT l.metric, l.line, '# HELP ' || l.metric || ' ' || h.d AS help, '# TYPE ' || l.metric || ' gauge' AS type
              FROM ({M.sql_lines(M.sql_all_samples())}) l JOIN (VALUES {_HELP_VALUES}) h(metric, d) USING (metric)""", "st", "latest", "retained"))
def exposition_text(spark, sf):
    lines = M.lines(QUERIES["sink_metrics"].build(spark, sf))
    helps = M.help_lines(spark)   # fixed 17-row catalogue: bounded, broadcast
    return lines.join(F.broadcast(helps), "metric").select("metric", "line", "help", "type")


# --- S15 / A21: dashboard document --------------------------------------------------------------------


@register("sink_snapshot_json", ids="S15 A21")
def sink_snapshot_json(spark, sf):
    """One JSON document assembled from bounded sections only (latest cycle per service,
    last 100 events, 360-cycle history, intelligence).  The unbounded sections —
    every active error and every board — stay tables (``active_errors``, ``latest_sources``)."""
    services = QUERIES["latest_cycle"].build(spark, sf)
    events = QUERIES["recent_events"].build(spark, sf)
    hist = QUERIES["history_by_service"].build(spark, sf)
    intel = QUERIES["intelligence_snapshot"].build(spark, sf)

    def section(df, name, key):
        return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*key, F.struct(*df.columns).alias("r"))))).alias(name))

    doc = section(services, "services", [F.col("service")]).select(
        "services",
        section(events, "recent_events", [(-F.col("seq")).alias("k")]).scalar().alias("recent_events"),
        section(hist, "history_by_service", [F.col("service"), F.col("last_cycle_ts")]).scalar().alias("history_by_service"),
        intel.select(F.to_json(F.struct(*intel.columns))).scalar().alias("intelligence"))
    return doc.select(F.to_json(F.struct(*[F.col(c) for c in doc.columns])).alias("snapshot"))


# --- S15 / A20 / A21 in long form: every entry of every section a row -----------------------------------

_JSON = {n: "json_object(" + ", ".join(f"'{f}', {f}" for f in fields) + ")" for n, fields in SN.FIELDS.items()}


def _section_sql(name: str, rows: str, part: str, order_1: str, order_2: str, section: str = "") -> str:
    return (f"SELECT '{section or name}' AS section, {part} AS part, CAST({order_1} AS BIGINT) AS order_1, {order_2} AS order_2, "
            f"CAST({_JSON[name]} AS VARCHAR) AS row FROM ({rows}) r")


def _dashboard_sql() -> str:
    err = f"SELECT *, {X.sql.format_ts('last_error_ts')} AS last_error_display FROM st WHERE is_error = 1"
    cycle = f"{X.sql.format_ts('last_cycle_ts')} AS last_cycle_display"
    return PH.hsql(" UNION ALL ".join([
        _section_sql("services", f"SELECT *, CAST(summary_json AS JSON) AS summary, {cycle} FROM latest", "service", "0", "''"),
        *[_section_sql("active_errors", err, "service", "-last_error_ts", "source", s) for s in ("active_errors", "error_groups")],
        _section_sql("history_by_service", f"SELECT *, {cycle}, {X.sql.short_ts('last_cycle_ts')} AS last_cycle_short FROM win", "service", "last_cycle_ts", "''"),
        _section_sql("recent_events", f"SELECT *, seq AS id, {X.sql.format_ts('created_ts')} AS created_display FROM "
                                      f"(SELECT * FROM ev ORDER BY seq DESC LIMIT {R.RECENT_EVENTS}) e", "''", "-seq", "''"),
        _section_sql("latest_sources", "SELECT * FROM st", "service", "0", "source"),
    ]), "latest", "st", "win", "ev")


@register("dashboard_sections", ids="A21 S15", sql=_dashboard_sql)
def dashboard_sections(spark, sf):
    """Six sections of the dashboard document; the seventh is ``intelligence_sections``."""
    status = PH._status(spark, sf)
    cycles = PH._history(spark, sf)
    return SN.union([SN.services(H.latest_cycle(cycles)), SN.active_errors(H.active_errors(status)), SN.history(H.history_window(cycles)),
                     SN.recent_events(QUERIES["recent_events"].build(spark, sf)), SN.latest_sources(status)])


def _intelligence_sql() -> str:
    def total(name: str, rows: str) -> str:
        return f"SELECT 'intelligence' AS section, '{name}' AS part, CAST(0 AS BIGINT) AS order_1, '' AS order_2, CAST(({rows}) AS VARCHAR) AS row"

    def labels(label: str) -> str:
        return (f"SELECT 'intelligence', '{label}_distribution', CAST(-n AS BIGINT), {label}, CAST(json_object('{label}', {label}, 'count', n) AS VARCHAR) "
                f"FROM (SELECT {label}, count(*) AS n FROM cur GROUP BY {label}) d")

    top = (f"SELECT provider, company, title, job_location AS location, url, role_type, seniority, location_fit, relevance_score, confidence, reason, "
           f"classified_ts FROM cur WHERE relevance_score >= {PS.TH} ORDER BY classified_ts DESC, relevance_score DESC, provider, external_job_id "
           f"LIMIT {R.LATEST_HIGH_RELEVANCE}")
    body = " UNION ALL ".join([
        total("total_jobs", "SELECT count(*) FROM jobs"),
        total("classified_jobs", "SELECT count(*) FROM (SELECT DISTINCT provider, external_job_id FROM cls) d"),
        total("high_relevance_jobs", f"SELECT count(*) FROM cur WHERE relevance_score >= {PS.TH}"),
        _section_sql("latest_high_relevance_jobs", top, "'latest_high_relevance_jobs'", "-classified_ts",
                     "lpad(CAST(100 - relevance_score AS VARCHAR), 3, '0') || provider", "intelligence"),
        labels("role_type"), labels("seniority")])
    return with_views(["v_versions"], body, [*PS.store_ctes(with_cls=True), ("cur", PS._CUR)])


@register("intelligence_sections", ids="A20 A21 S15", sql=_intelligence_sql)
def intelligence_sections(spark, sf):
    current, jobs = PS._current(spark, sf)
    return SN.intelligence(PS._classifications(spark, sf), PS._saved(current), jobs, PS.TH, R.LATEST_HIGH_RELEVANCE)


# --- R3: classify new/changed content inside the stream ------------------------------------------------


@register("stream_classify", ids="R3 R10 C9 J2", sql=lambda: QUERIES["tbl_classifications"].oracle())
def stream_classify(spark, sf):
    from jobsignal.plans.streams import YEAR_CUTS

    return SP.classify_stream(spark, PS.versions(spark, sf), YEAR_CUTS)


# --- U5: notified ids per board -------------------------------------------------------------


@register("notified_ids_json", ids="U5",
          sql=lambda: PA.asql("SELECT service, source, CAST(to_json(external_job_id) AS VARCHAR) AS notified_job_id_json "
                              "FROM (SELECT service, source, external_job_id FROM notified UNION SELECT service, source, external_job_id FROM batch) u",
                              "notified", "batch"))
def notified_ids_json(spark, sf):
    """The members of each board's JSON list, one row each: a board's list has no bound."""
    u = QUERIES["notified_union"].build(spark, sf)
    quoted = F.regexp_replace(F.to_json(F.array("external_job_id")), r"^\[|\]$", "")
    return u.select("service", "source", quoted.alias("notified_job_id_json"))
