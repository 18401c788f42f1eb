"""Queries over poll outcomes: health state, events, cycles, dashboard, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.operators import health as H
from jobsignal.operators import metrics as M
from jobsignal.plans.registry import register
from jobsignal.sources.testdata import v_cycles, v_status_log, with_views

ERR = P.sql.is_error_status("status")
B = "service, source"
ORD = "checked_ts, seq"
ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ESC = r"""replace(replace(status, '\', '\\'), '"', '\"')"""

CTES = {
    "f": f"SELECT *, CASE WHEN {ERR} THEN 1 ELSE 0 END AS is_error FROM v_status_log",
    "g": f"SELECT *, sum(1 - is_error) OVER (PARTITION BY {B} ORDER BY {ORD} {ROWS}) AS _grp FROM f",
    "w1": (f"SELECT seq, service, source, status, detail, checked_ts, is_error, CAST(sum(is_error) OVER "
           f"(PARTITION BY {B}, _grp ORDER BY {ORD} {ROWS}) AS INTEGER) AS consecutive_errors FROM g"),
    "ev": (f"SELECT seq, service, source, status, detail, is_error, checked_ts AS created_ts FROM ("
           f"SELECT *, lag(seq) OVER w AS _pseq, lag(status) OVER w AS _ps, lag(coalesce(detail, '')) OVER w AS _pd, "
           f"lag(is_error) OVER w AS _pe FROM f WINDOW w AS (PARTITION BY {B} ORDER BY {ORD})) x "
           "WHERE _pseq IS NULL OR is_error = 1 OR _ps <> status OR _pd <> coalesce(detail, '') OR _pe <> is_error"),
    "st": (f"SELECT service, source, first(status ORDER BY checked_ts DESC, seq DESC) AS status, "
           f"first(detail ORDER BY checked_ts DESC, seq DESC) AS detail, first(is_error ORDER BY checked_ts DESC, seq DESC) AS is_error, "
           f"max(checked_ts) AS last_checked_ts, max(CASE WHEN is_error = 0 THEN checked_ts END) AS last_ok_ts, "
           f"max(CASE WHEN is_error = 1 THEN checked_ts END) AS last_error_ts, "
           f"first(consecutive_errors ORDER BY checked_ts DESC, seq DESC) AS consecutive_errors FROM w1 GROUP BY {B}"),
    "hist": (f"SELECT service, cycle_ts AS last_cycle_ts, CASE WHEN max(CASE WHEN {ERR} AND n > 0 THEN 1 ELSE 0 END) = 1 "
             f"THEN 'error' ELSE 'ok' END AS status, "
             f"'{{' || string_agg('\"' || {ESC} || '\": ' || CAST(n AS VARCHAR), ', ' ORDER BY status) || '}}' AS summary_json, "
             f"string_agg(status || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY status) AS summary_text, "
             f"CAST(sum(CASE WHEN {ERR} THEN n ELSE 0 END) AS BIGINT) AS error_count, "
             f"CAST(sum(CASE WHEN NOT {ERR} THEN n ELSE 0 END) AS BIGINT) AS ok_count, "
             f"max(duration_ms) AS cycle_duration_ms FROM v_cycles GROUP BY service, cycle_ts"),
    "latest": ("SELECT service, arg_max(last_cycle_ts, last_cycle_ts) AS last_cycle_ts, arg_max(status, last_cycle_ts) AS status, "
               "arg_max(summary_json, last_cycle_ts) AS summary_json, arg_max(summary_text, last_cycle_ts) AS summary_text, "
               "arg_max(error_count, last_cycle_ts) AS error_count, arg_max(ok_count, last_cycle_ts) AS ok_count, "
               "arg_max(cycle_duration_ms, last_cycle_ts) AS cycle_duration_ms FROM hist GROUP BY service"),
    "win": f"SELECT * FROM hist ORDER BY last_cycle_ts DESC, service LIMIT {R.HISTORY_WINDOW}",
    "retained": f"SELECT * FROM ev ORDER BY seq DESC LIMIT {R.EVENT_RETENTION}",
}
_DEPS = {"g": ["f"], "w1": ["f", "g"], "ev": ["f"], "st": ["f", "g", "w1"], "latest": ["hist"], "win": ["hist"],
         "retained": ["f", "ev"]}


def hsql(body: str, *names: str) -> str:
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    views = ["v_status_log"] + (["v_cycles"] if any(n in ("hist", "latest", "win") for n in order) else [])
    return with_views(views, body, [(n, CTES[n]) for n in order])


def _log(spark, sf):
    return v_status_log(spark, sf)


def _status(spark, sf):
    return H.source_status(_log(spark, sf))


def _events(spark, sf):
    return H.change_events(_log(spark, sf))


def _history(spark, sf):
    return H.cycle_rollup(v_cycles(spark, sf))


# --- per-board state ----------------------------------------------------------------


@register("is_error_status", ids="F7", sql=lambda: hsql("SELECT seq, status, is_error FROM f", "f"))
def is_error_status(spark, sf):
    return H.with_error_flag(_log(spark, sf)).select("seq", "status", "is_error")


@register("consecutive_errors", ids="W1",
          sql=lambda: hsql("SELECT seq, service, source, status, is_error, consecutive_errors FROM w1", "w1"))
def consecutive_errors(spark, sf):
    return H.consecutive_errors(_log(spark, sf)).select("seq", "service", "source", "status", "is_error", "consecutive_errors")


@register("source_change_events", ids="W2 S10 R6", sql=lambda: hsql("SELECT * FROM ev", "ev"))
def source_change_events(spark, sf):
    return _events(spark, sf)


@register("source_status_latest", ids="W3 S9 J7", sql=lambda: hsql("SELECT * FROM st", "st"))
def source_status_latest(spark, sf):
    return _status(spark, sf)


@register("event_retention", ids="T8 J8", sql=lambda: hsql("SELECT * FROM retained", "retained"))
def event_retention(spark, sf):
    return H.newest(_events(spark, sf), R.EVENT_RETENTION, F.desc("seq"))


@register("recent_events", ids="T3", sql=lambda: hsql(f"SELECT * FROM ev ORDER BY seq DESC LIMIT {R.RECENT_EVENTS}", "ev"))
def recent_events(spark, sf):
    return H.newest(_events(spark, sf), R.RECENT_EVENTS, F.desc("seq"))


@register("recent_error_events", ids="A11 F17",
          sql=lambda: hsql("SELECT service, status, count(*) AS count FROM retained WHERE is_error = 1 GROUP BY service, status", "retained"))
def recent_error_events(spark, sf):
    kept = H.newest(_events(spark, sf), R.EVENT_RETENTION, F.desc("seq"))
    return kept.where(F.col("is_error") == 1).groupBy("service", "status").agg(F.count(F.lit(1)).alias("count"))


@register("active_errors", ids="F10 T4",
          sql=lambda: hsql("SELECT service, source, status, detail, last_checked_ts, last_error_ts, consecutive_errors FROM st WHERE is_error = 1", "st"))
def active_errors(spark, sf):
    return H.active_errors(_status(spark, sf)).orderBy("service", F.desc("last_error_ts"), "source")


@register("error_groups", ids="A14",
          sql=lambda: hsql("SELECT service, last_error_ts, source, status, consecutive_errors FROM st WHERE is_error = 1", "st"))
def error_groups(spark, sf):
    """Active errors of each service, newest first: a global range sort, no service in one task."""
    a = H.active_errors(_status(spark, sf)).select("service", "last_error_ts", "source", "status", "consecutive_errors")
    return a.orderBy("service", F.desc("last_error_ts"), "source")


@register("latest_sources", ids="T5",
          sql=lambda: hsql("SELECT service, source, status, detail, is_error, last_checked_ts, consecutive_errors FROM st", "st"))
def latest_sources(spark, sf):
    return _status(spark, sf).select("service", "source", "status", "detail", "is_error", "last_checked_ts",
                                     "consecutive_errors").orderBy("service", "source")


@register("top_consecutive_errors", ids="T7",
          sql=lambda: hsql(f"SELECT service, source, status, consecutive_errors FROM st ORDER BY consecutive_errors DESC, service, source LIMIT {R.TOP_CONSECUTIVE}", "st"))
def top_consecutive_errors(spark, sf):
    s = _status(spark, sf).select("service", "source", "status", "consecutive_errors")
    return H.newest(s, R.TOP_CONSECUTIVE, F.desc("consecutive_errors"), "service", "source")


# --- service roll-ups ------------------------------------------------------------------


@register("service_error_ratio", ids="A6",
          sql=lambda: hsql("SELECT service, count(*) AS sources_total, CAST(sum(is_error) AS BIGINT) AS source_errors, "
                           "CASE WHEN count(*) > 0 THEN CAST(sum(is_error) AS DOUBLE) / count(*) ELSE 0.0 END AS source_error_ratio "
                           "FROM st GROUP BY service", "st"))
def service_error_ratio(spark, sf):
    return H.service_error_ratio(_status(spark, sf))


@register("board_error_count", ids="A16",
          sql=lambda: hsql("SELECT service, count(*) AS active_errors FROM st WHERE is_error = 1 GROUP BY service", "st"))
def board_error_count(spark, sf):
    return H.active_errors(_status(spark, sf)).groupBy("service").agg(F.count(F.lit(1)).alias("active_errors"))


@register("total_active_errors", ids="A12",
          sql=lambda: hsql("SELECT CAST(coalesce(sum(is_error), 0) AS BIGINT) AS total_active_errors FROM st", "st"))
def total_active_errors(spark, sf):
    return _status(spark, sf).agg(F.coalesce(F.sum("is_error"), F.lit(0)).cast("long").alias("total_active_errors"))


@register("overall_error_ratio", ids="A13",
          sql=lambda: hsql("SELECT CAST(coalesce(sum(is_error), 0) AS DOUBLE) / greatest(count(*), 1) AS overall_error_ratio FROM st", "st"))
def overall_error_ratio(spark, sf):
    s = _status(spark, sf)
    return s.agg((F.coalesce(F.sum("is_error"), F.lit(0)).cast("double") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("overall_error_ratio"))


@register("threshold_band", ids="X26",
          sql=lambda: hsql(f"""SELECT CASE WHEN e >= {R.ERROR_COUNT_BANDS[0]} THEN 'red' ELSE 'green' END AS errors_band,
              CASE WHEN r >= {R.ERROR_RATIO_BANDS[1]} THEN 'red' WHEN r >= {R.ERROR_RATIO_BANDS[0]} THEN 'orange' ELSE 'green' END AS ratio_band
              FROM (SELECT coalesce(sum(is_error), 0) AS e, CAST(coalesce(sum(is_error), 0) AS DOUBLE) / greatest(count(*), 1) AS r FROM st) x""", "st"))
def threshold_band(spark, sf):
    s = _status(spark, sf).agg(F.coalesce(F.sum("is_error"), F.lit(0)).alias("e"),
                               (F.coalesce(F.sum("is_error"), F.lit(0)).cast("double") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("r"))
    return s.select(*M.threshold_bands(F.col("e"), F.col("r")))


# --- cycles ---------------------------------------------------------------------------------


@register("cycle_rollup", ids="A9 S12 X19", sql=lambda: hsql("SELECT * FROM hist", "hist"))
def cycle_rollup(spark, sf):
    return _history(spark, sf)


@register("cycle_status_counts", ids="A7",
          sql=lambda: with_views(["v_cycles"], "SELECT service, cycle_ts, status, CAST(sum(n) AS BIGINT) AS boards FROM v_cycles GROUP BY ALL"))
def cycle_status_counts(spark, sf):
    return H.cycle_status_counts(v_cycles(spark, sf))


@register("cycle_summary_text", ids="A22",
          sql=lambda: hsql("SELECT service, last_cycle_ts, summary_text FROM hist", "hist"))
def cycle_summary_text(spark, sf):
    return _history(spark, sf).select("service", "last_cycle_ts", "summary_text")


@register("latest_cycle", ids="W9 S11 T16", sql=lambda: hsql("SELECT * FROM latest", "latest"))
def latest_cycle(spark, sf):
    return H.latest_cycle(_history(spark, sf)).orderBy("service")


@register("latest_cycle_sources", ids="A10",
          sql=lambda: hsql(f"""SELECT c.service, c.status AS source_status, CAST(sum(c.n) AS BIGINT) AS boards,
              {P.sql.is_error_status('c.status')} AS is_error
              FROM v_cycles c JOIN latest l ON c.service = l.service AND c.cycle_ts = l.last_cycle_ts GROUP BY ALL""", "latest"))
def latest_cycle_sources(spark, sf):
    latest = H.latest_cycle(_history(spark, sf)).select("service", F.col("last_cycle_ts").alias("cycle_ts"))
    c = v_cycles(spark, sf).join(latest, ["service", "cycle_ts"])
    g = c.groupBy("service", F.col("status").alias("source_status")).agg(F.sum("n").cast("long").alias("boards"))
    return g.withColumn("is_error", P.is_error_status(F.col("source_status")))


@register("cycle_status_metric", ids="A24",
          sql=lambda: hsql("SELECT service, status, 1 AS value FROM latest", "latest"))
def cycle_status_metric(spark, sf):
    return H.latest_cycle(_history(spark, sf)).select("service", "status", F.lit(1).alias("value"))


@register("cycle_history_window", ids="T6 J9", sql=lambda: hsql("SELECT * FROM win", "win"))
def cycle_history_window(spark, sf):
    return H.history_window(_history(spark, sf)).orderBy("service", "last_cycle_ts")


@register("cycle_retention", ids="T9 J8",
          sql=lambda: hsql(f"SELECT service, last_cycle_ts, status FROM hist ORDER BY last_cycle_ts DESC, service DESC LIMIT {R.CYCLE_RETENTION}", "hist"))
def cycle_retention(spark, sf):
    h = _history(spark, sf).select("service", "last_cycle_ts", "status")
    return H.newest(h, R.CYCLE_RETENTION, F.desc("last_cycle_ts"), F.desc("service"))


@register("trend_points", ids="W10",
          sql=lambda: hsql(f"""SELECT service, last_cycle_ts, error_count, ok_count FROM (
              SELECT *, row_number() OVER (PARTITION BY service ORDER BY last_cycle_ts DESC) AS rn FROM win) x WHERE rn <= {R.TREND_POINTS}""", "win"))
def trend_points(spark, sf):
    return H.trend_points(H.history_window(_history(spark, sf))).select("service", "last_cycle_ts", "error_count", "ok_count")


@register("trend_axis_max", ids="A23",
          sql=lambda: hsql(f"""SELECT service, greatest(1, max(greatest(error_count, ok_count))) AS axis_max FROM (
              SELECT *, row_number() OVER (PARTITION BY service ORDER BY last_cycle_ts DESC) AS rn FROM win) x
              WHERE rn <= {R.TREND_POINTS} GROUP BY service""", "win"))
def trend_axis_max(spark, sf):
    t = H.trend_points(H.history_window(_history(spark, sf)))
    return t.groupBy("service").agg(F.greatest(F.lit(1), F.max(F.greatest("error_count", "ok_count"))).alias("axis_max"))


@register("history_by_service", ids="A15",
          sql=lambda: hsql("SELECT service, last_cycle_ts, status, error_count, ok_count, cycle_duration_ms FROM win", "win"))
def history_by_service(spark, sf):
    w = H.history_window(_history(spark, sf)).select("service", "last_cycle_ts", "status", "error_count", "ok_count", "cycle_duration_ms")
    return w.orderBy("service", "last_cycle_ts")


@register("cycle_duration_seconds", ids="X16",
          sql=lambda: hsql("SELECT service, last_cycle_ts, cycle_duration_ms / 1000 AS cycle_duration_seconds FROM hist", "hist"))
def cycle_duration_seconds(spark, sf):
    return _history(spark, sf).select("service", "last_cycle_ts", (F.col("cycle_duration_ms") / 1000).alias("cycle_duration_seconds"))


@register("board_error_details", ids="J10",
          sql=lambda: hsql("""SELECT l.service, l.status, e.source, e.status AS error_status, e.detail, e.consecutive_errors FROM latest l
              LEFT JOIN (SELECT * FROM st WHERE is_error = 1) e USING (service)""", "latest", "st"))
def board_error_details(spark, sf):
    """Each service's latest cycle with its active errors, one row per error."""
    errs = H.active_errors(_status(spark, sf)).select("service", "source", F.col("status").alias("error_status"), "detail", "consecutive_errors")
    return H.latest_cycle(_history(spark, sf)).select("service", "status").join(errs, "service", "left")


# --- display helpers ---------------------------------------------------------------------


@register("status_badge", ids="X22",
          sql=lambda: hsql(f"SELECT seq, status, {X.sql.status_badge('status')} AS badge FROM f", "f"))
def status_badge(spark, sf):
    return _log(spark, sf).select("seq", "status", X.status_badge(F.col("status")).alias("badge"))


@register("format_ts", ids="X14",
          sql=lambda: hsql(f"SELECT service, source, {X.sql.format_ts('last_error_ts')} AS last_error_display, {X.sql.format_ts('last_checked_ts')} AS last_checked_display FROM st", "st"))
def format_ts(spark, sf):
    return _status(spark, sf).select("service", "source", X.format_ts(F.col("last_error_ts")).alias("last_error_display"),
                                     X.format_ts(F.col("last_checked_ts")).alias("last_checked_display"))


@register("short_ts", ids="X15",
          sql=lambda: hsql(f"SELECT service, last_cycle_ts, {X.sql.short_ts('last_cycle_ts')} AS last_cycle_short FROM hist", "hist"))
def short_ts(spark, sf):
    return _history(spark, sf).select("service", "last_cycle_ts", X.short_ts(F.col("last_cycle_ts")).alias("last_cycle_short"))


# --- metrics ----------------------------------------------------------------------------


@register("source_metrics", ids="P18",
          sql=lambda: hsql(M.sql_source_metrics(), "st"))
def source_metrics(spark, sf):
    return M.source_samples(_status(spark, sf))


@register("sink_metrics", ids="S16 X17 X18 A6 A10 A11 A24 P18",
          sql=lambda: hsql(M.sql_all_samples(), "st", "latest", "retained"))
def sink_metrics(spark, sf):
    return M.all_samples(_status(spark, sf), H.latest_cycle(_history(spark, sf)),
                         H.newest(_events(spark, sf), R.EVENT_RETENTION, F.desc("seq")))


@register("metric_lines", ids="X17",
          sql=lambda: hsql(M.sql_lines(M.sql_all_samples()), "st", "latest", "retained"))
def metric_lines(spark, sf):
    s = sink_metrics(spark, sf)
    return M.lines(s)


@register("cycle_summary_entries", ids="X19 A7",
          sql=lambda: with_views(["v_cycles"], "SELECT service, cycle_ts, status, CAST(sum(n) AS BIGINT) AS boards FROM v_cycles GROUP BY ALL"))
def cycle_summary_entries(spark, sf):
    """Decoded from the stored text; the SQL counts the cycles anew."""
    return H.summary_entries(_history(spark, sf))
