"""Dashboard and intelligence snapshots in long form.

One row per entry: ``section``, ``part`` (the service or list it stands in),
``order_1`` and ``order_2`` (entries of a part stand by these two), ``row`` (the
entry as JSON text, display fields included).  Three sections have no bound
(every active error twice, every board), so the entries carry their place as
keys: a reader sorts what it shows, and nothing is numbered or nested whole.

Defined cases: null fields are written as null; a section without data has no
rows; the three totals are there even without data, as 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsignal.functions import text as X
from jobsignal.operators import reports as REP

COLUMNS = ["section", "part", "order_1", "order_2", "row"]
#: Fields of each section's entries, in the order in which they are written.
FIELDS = {
    "services": ["service", "status", "last_cycle_ts", "cycle_duration_ms", "summary", "last_cycle_display"],
    "active_errors": ["service", "source", "status", "detail", "last_checked_ts", "last_error_ts", "consecutive_errors", "last_error_display"],
    "history_by_service": ["service", "status", "error_count", "ok_count", "last_cycle_ts", "cycle_duration_ms", "last_cycle_display", "last_cycle_short"],
    "recent_events": ["id", "service", "source", "status", "detail", "is_error", "created_ts", "created_display"],
    "latest_sources": ["service", "source", "status", "detail", "is_error", "last_checked_ts", "consecutive_errors"],
    "latest_high_relevance_jobs": ["provider", "company", "title", "location", "url", "role_type", "seniority", "location_fit",
                                   "relevance_score", "confidence", "reason", "classified_ts"],
}


def json_row(fields: Iterable[str]) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def section(df: DataFrame, name: str, fields: list[str], part: Column, order_1: Column, order_2: Column) -> DataFrame:
    return df.select(F.lit(name).alias("section"), part.alias("part"), order_1.cast("long").alias("order_1"),
                     order_2.cast("string").alias("order_2"), json_row(fields).alias("row"))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def services(latest: DataFrame) -> DataFrame:
    """The latest cycle of each service with its summary as an object."""
    shown = latest.withColumn("summary", F.from_json("summary_json", "map<string,bigint>")) \
                  .withColumn("last_cycle_display", X.format_ts(F.col("last_cycle_ts")))
    return section(shown, "services", FIELDS["services"], F.col("service"), F.lit(0), F.lit(""))


def active_errors(errors: DataFrame) -> DataFrame:
    """Every active error, newest first within its service: as one list and grouped."""
    shown = errors.withColumn("last_error_display", X.format_ts(F.col("last_error_ts")))
    rows = section(shown, "active_errors", FIELDS["active_errors"], F.col("service"), -F.col("last_error_ts"), F.col("source"))
    return rows.withColumn("section", F.explode(F.array(F.lit("active_errors"), F.lit("error_groups"))))


def history(window: DataFrame) -> DataFrame:
    shown = window.withColumn("last_cycle_display", X.format_ts(F.col("last_cycle_ts"))) \
                  .withColumn("last_cycle_short", X.short_ts(F.col("last_cycle_ts")))
    return section(shown, "history_by_service", FIELDS["history_by_service"], F.col("service"), F.col("last_cycle_ts"), F.lit(""))


def recent_events(events: DataFrame) -> DataFrame:
    shown = events.withColumn("id", F.col("seq")).withColumn("created_display", X.format_ts(F.col("created_ts")))
    return section(shown, "recent_events", FIELDS["recent_events"], F.lit(""), -F.col("seq"), F.lit(""))


def latest_sources(status: DataFrame) -> DataFrame:
    return section(status, "latest_sources", FIELDS["latest_sources"], F.col("service"), F.lit(0), F.col("source"))


def intelligence(classifications: DataFrame, current: DataFrame, jobs: DataFrame, threshold: int, limit: int) -> DataFrame:
    """Three totals, the newest high-relevance jobs and two distributions."""
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit("intelligence").alias("section"), F.lit(name).alias("part"), F.lit(0).cast("long").alias("order_1"),
                         F.lit("").alias("order_2"), F.col(name).cast("string").alias("row"))

    def labels(label: str) -> DataFrame:
        counts = REP.distribution(current, jobs, label)
        rows = section(counts, "intelligence", [label, "count"], F.lit(f"{label}_distribution"), -F.col("count"), F.col(label))
        return rows

    latest = REP.latest_high_relevance(current, jobs, threshold, limit)
    rank = F.concat(F.lpad((100 - F.col("relevance_score")).cast("string"), 3, "0"), F.col("provider"))
    return union([
        total(REP.total_jobs(jobs), "total_jobs"),
        total(REP.classified_jobs(classifications), "classified_jobs"),
        total(REP.high_relevance_jobs(current, jobs, threshold), "high_relevance_jobs"),
        section(latest, "intelligence", FIELDS["latest_high_relevance_jobs"], F.lit("latest_high_relevance_jobs"), -F.col("classified_ts"), rank),
        labels("role_type"), labels("seniority"),
    ])
