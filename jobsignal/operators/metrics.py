"""Metric samples and exposition lines.

Samples are long-form rows ``(metric, labels, value, value_text)``; ``labels``
is the rendered, key-sorted label text.  A scrape reads each health table once:
samples of one row are stacked, coarser grains are grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.functions.text import q

PREFIX = R.METRIC_PREFIX

# Metric catalogue (name suffix, help text), all gauges.
HELP = (
    ("exporter_up", "Whether the job tracker metrics exporter is running."),
    ("status_db_last_scrape_timestamp_seconds", "Unix timestamp of the exporter scrape."),
    ("status_db_readable", "Whether the monitor status SQLite database can be read."),
    ("sources_total", "Tracked source count by provider service."),
    ("source_errors", "Active error source count by provider service."),
    ("source_error_ratio", "Active source error ratio by provider service."),
    ("source_error_state", "Per-source active error state."),
    ("source_consecutive_errors", "Per-source consecutive error count."),
    ("source_last_checked_timestamp_seconds", "Unix timestamp of source last check."),
    ("source_last_error_timestamp_seconds", "Unix timestamp of source last error."),
    ("service_cycle_duration_seconds", "Latest monitor cycle duration by service."),
    ("service_last_cycle_timestamp_seconds", "Latest monitor cycle Unix timestamp by service."),
    ("service_cycle_status", "Latest monitor cycle status by service."),
    ("service_cycle_sources", "Latest monitor cycle source count by status label."),
    ("service_cycle_error_sources", "Latest monitor cycle source error count by service."),
    ("service_cycle_ok_sources", "Latest monitor cycle non-error source count by service."),
    ("recent_error_events", "Error events currently retained in SQLite by service and status."),
)


def labels_text(pairs: list[tuple[str, Column]]) -> Column:
    """X17 label rendering, keys sorted: k1="v1",k2="v2"."""
    parts = []
    for i, (k, v) in enumerate(sorted(pairs, key=lambda p: p[0])):
        parts += [F.lit(("," if i else "") + f'{k}="'), X.escape_label(v), F.lit('"')]
    return F.concat(*parts) if parts else F.lit("")


def _sample(name: str, labels: list[tuple[str, Column]], value: Column, integral: bool = True, when: Column | None = None) -> Column:
    """One sample as a struct; where ``when`` doesn't hold its metric is null and ``_stack`` leaves it out."""
    text = value.cast("long").cast("string") if integral else value.cast("double").cast("string")
    metric = F.lit(PREFIX + name)
    return F.struct((metric if when is None else F.when(when, metric)).alias("metric"), labels_text(labels).alias("labels"),
                    value.cast("double").alias("value"), text.alias("value_text"))


def _stack(df: DataFrame, samples: Column) -> DataFrame:
    """The samples of every row below each other: one pass over ``df``, whatever their number."""
    return df.select(F.inline(F.filter(samples, lambda s: s["metric"].isNotNull())))


def _board_samples(when: Column | None = None) -> list[Column]:
    lab = [("service", F.col("service")), ("source", F.col("source")), ("status", F.col("status"))]
    once = F.coalesce(F.col("last_error_ts"), F.lit(0)) != 0
    return [
        _sample("source_error_state", lab, F.col("is_error"), when=when),
        _sample("source_consecutive_errors", lab, F.coalesce(F.col("consecutive_errors"), F.lit(0)), when=when),
        _sample("source_last_checked_timestamp_seconds", lab, F.coalesce(F.col("last_checked_ts"), F.lit(0)), when=when),
        _sample("source_last_error_timestamp_seconds", lab, F.col("last_error_ts"), when=once if when is None else when & once),
    ]


def source_samples(status: DataFrame) -> DataFrame:
    """Per-source gauges; the last-error gauge only when a last error exists."""
    return _stack(status, F.array(*_board_samples()))


def status_samples(status: DataFrame) -> DataFrame:
    """Samples of boards, services and the scrape (its time is the newest check): the three grains are
    grouping sets of one aggregate, so ``status`` is computed once and only its partial sums of the
    coarse grains travel.  A row that counts nothing keeps the scrape's samples where there is no board."""
    nothing = status.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in status.schema if f.name not in ("is_error", "_real")], F.lit(0).alias("is_error"), F.lit(0).alias("_real"))
    rows = status.withColumn("_real", F.lit(1)).unionByName(nothing)
    keys = [F.col("service"), F.col("source"), F.col("status")]
    grains = rows.groupingSets([keys, keys[:1], []], *keys).agg(
        F.grouping_id().alias("_grain"), F.sum("_real").alias("_boards"), F.sum("is_error").alias("is_error"),
        *[F.max(c).alias(c) for c in ("consecutive_errors", "last_checked_ts", "last_error_ts")])
    some = F.col("_boards") > 0
    board, service, scrape = (F.col("_grain") == 0) & some, (F.col("_grain") == 3) & some, F.col("_grain") == 7
    svc = [("service", F.col("service"))]
    return _stack(grains, F.array(
        _sample("exporter_up", [], F.lit(1), when=scrape),
        _sample("status_db_last_scrape_timestamp_seconds", [], F.col("last_checked_ts"), when=scrape),
        _sample("status_db_readable", [], F.lit(1), when=scrape),
        _sample("sources_total", svc, F.col("_boards"), when=service),
        _sample("source_errors", svc, F.col("is_error"), when=service),
        _sample("source_error_ratio", svc, F.try_divide(F.col("is_error"), F.col("_boards")), integral=False, when=service),
        *_board_samples(board)))


def cycle_samples(latest: DataFrame) -> DataFrame:
    """Samples of each service's latest cycle; those by status are decoded from its stored summary."""
    svc = [("service", F.col("service"))]
    own = F.array(
        _sample("service_cycle_duration_seconds", svc, F.coalesce(F.col("cycle_duration_ms"), F.lit(0)) / 1000, integral=False),
        _sample("service_last_cycle_timestamp_seconds", svc, F.coalesce(F.col("last_cycle_ts"), F.lit(0))),
        _sample("service_cycle_status", svc + [("status", F.col("status"))], F.lit(1)),
        _sample("service_cycle_error_sources", svc, F.col("error_count")),
        _sample("service_cycle_ok_sources", svc, F.col("ok_count")))
    summary = F.map_entries(F.from_json("summary_json", "map<string,bigint>"))
    by_status = F.transform(summary, lambda e: _sample("service_cycle_sources", svc + [("source_status", e["key"])], e["value"]))
    return _stack(latest, F.concat(own, F.coalesce(by_status, F.filter(own, lambda s: F.lit(False)))))


def event_samples(retained_events: DataFrame) -> DataFrame:
    """Retained error events by service and status."""
    g = retained_events.where(F.col("is_error") == 1).groupBy("service", "status").agg(F.count(F.lit(1)).alias("n"))
    return _stack(g, F.array(_sample("recent_error_events", [("service", F.col("service")), ("status", F.col("status"))], F.col("n"))))


def all_samples(status: DataFrame, latest: DataFrame, retained_events: DataFrame) -> DataFrame:
    """Every sample of one scrape; each of the three inputs is computed once."""
    return status_samples(status).unionByName(cycle_samples(latest)).unionByName(event_samples(retained_events))


def lines(samples: DataFrame) -> DataFrame:
    """``name{labels} value`` exposition lines."""
    line = F.when(F.col("labels") == "", F.concat(F.col("metric"), F.lit(" "), F.col("value_text"))).otherwise(
        F.concat(F.col("metric"), F.lit("{"), F.col("labels"), F.lit("} "), F.col("value_text")))
    return samples.select("metric", line.alias("line"))


def help_lines(spark) -> DataFrame:
    """HELP/TYPE header lines from the fixed catalogue (a literal 17-row table)."""
    rows = [(PREFIX + n, f"# HELP {PREFIX}{n} {d}", f"# TYPE {PREFIX}{n} gauge") for n, d in HELP]
    return spark.createDataFrame(rows, "metric string, help string, type string")


def threshold_bands(errors: Column, ratio: Column) -> list[Column]:
    """Headline colours: errors >= 1 red; ratio bands at 5 % and 20 %."""
    lo, hi = R.ERROR_RATIO_BANDS
    return [
        F.when(errors >= R.ERROR_COUNT_BANDS[0], F.lit("red")).otherwise(F.lit("green")).alias("errors_band"),
        F.when(ratio >= hi, F.lit("red")).when(ratio >= lo, F.lit("orange")).otherwise(F.lit("green")).alias("ratio_band"),
    ]


# ---------------------------------------------------------------------------
# DuckDB twins (expect CTEs st, latest, retained and view v_cycles / v_status_log)
# ---------------------------------------------------------------------------


def _sql_labels(pairs: list[tuple[str, str]]) -> str:
    parts = []
    for i, (k, v) in enumerate(sorted(pairs)):
        parts.append(q(("," if i else "") + f'{k}="') + f" || {X.sql.escape_label(v)} || " + q('"'))
    return " || ".join(parts) if parts else "''"


def _sql_sample(name: str, labels: list[tuple[str, str]], value: str, src: str, integral: bool = True, where: str = "") -> str:
    text = f"CAST(CAST({value} AS BIGINT) AS VARCHAR)" if integral else f"CAST(CAST({value} AS DOUBLE) AS VARCHAR)"
    return (f"SELECT {q(PREFIX + name)} AS metric, {_sql_labels(labels)} AS labels, CAST({value} AS DOUBLE) AS value, "
            f"{text} AS value_text FROM {src}" + (f" WHERE {where}" if where else ""))


def sql_source_metrics() -> str:
    lab = [("service", "service"), ("source", "source"), ("status", "status")]
    return " UNION ALL ".join([
        _sql_sample("source_error_state", lab, "is_error", "st"),
        _sql_sample("source_consecutive_errors", lab, "coalesce(consecutive_errors, 0)", "st"),
        _sql_sample("source_last_checked_timestamp_seconds", lab, "coalesce(last_checked_ts, 0)", "st"),
        _sql_sample("source_last_error_timestamp_seconds", lab, "last_error_ts", "st", where="coalesce(last_error_ts, 0) <> 0"),
    ])


def sql_all_samples() -> str:
    svc = [("service", "service")]
    err = P.sql.is_error_status("status")
    one = "(SELECT max(checked_ts) AS ts FROM v_status_log) one"
    ratio = "(SELECT service, count(*) AS total, sum(is_error) AS errors FROM st GROUP BY service) r"
    lsrc = ("(SELECT c.service, c.status, sum(c.n) AS n FROM v_cycles c JOIN latest l ON c.service = l.service "
            "AND c.cycle_ts = l.last_cycle_ts GROUP BY c.service, c.status) ls")
    split = (f"(SELECT service, sum(CASE WHEN {err} THEN n ELSE 0 END) AS e, sum(CASE WHEN NOT {err} THEN n ELSE 0 END) AS o "
             f"FROM {lsrc} GROUP BY service) sp")
    rec = "(SELECT service, status, count(*) AS n FROM retained WHERE is_error = 1 GROUP BY service, status) rec"
    return " UNION ALL ".join([
        _sql_sample("exporter_up", [], "1", one),
        _sql_sample("status_db_last_scrape_timestamp_seconds", [], "ts", one),
        _sql_sample("status_db_readable", [], "1", one),
        _sql_sample("sources_total", svc, "total", ratio),
        _sql_sample("source_errors", svc, "errors", ratio),
        _sql_sample("source_error_ratio", svc, "CAST(errors AS DOUBLE) / total", ratio, integral=False),
        sql_source_metrics(),
        _sql_sample("service_cycle_duration_seconds", svc, "coalesce(cycle_duration_ms, 0) / 1000", "latest", integral=False),
        _sql_sample("service_last_cycle_timestamp_seconds", svc, "coalesce(last_cycle_ts, 0)", "latest"),
        _sql_sample("service_cycle_status", svc + [("status", "status")], "1", "latest"),
        _sql_sample("service_cycle_sources", svc + [("source_status", "status")], "n", lsrc),
        _sql_sample("service_cycle_error_sources", svc, "e", split),
        _sql_sample("service_cycle_ok_sources", svc, "o", split),
        _sql_sample("recent_error_events", svc + [("status", "status")], "n", rec),
    ])


def sql_lines(samples_sql: str) -> str:
    return (f"SELECT metric, CASE WHEN labels = '' THEN metric || ' ' || value_text "
            f"ELSE metric || '{{' || labels || '}} ' || value_text END AS line FROM ({samples_sql}) s")
