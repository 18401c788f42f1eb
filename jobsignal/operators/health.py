"""Board health state and cycle history.

Poll outcomes are rows ``(seq, service, source, status, detail, checked_ts)``.
Per-board ordered state (W1, W2) is two-level: windows over ``(service,
source, day bucket)`` ordered by ``(checked_ts, seq)`` plus a carry computed on
one summary row per bucket, so a board holding a large share of all polls is
spread over many tasks.  Board-level roll-ups are aggregations (one partial
row per task).  Global top-N
cuts (retention, recent events, history window) use ``orderBy().limit()``,
which plans as TakeOrderedAndProject (per-partition top-N, bounded merge),
never an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P

BOARD = ["service", "source"]


def _order() -> list[Column]:
    return [F.col("checked_ts"), F.col("seq")]


def with_error_flag(log: DataFrame) -> DataFrame:
    """F7 as the integer flag stored by the original (1 = error)."""
    return log.withColumn("is_error", P.is_error_status(F.col("status")).cast("int"))


BUCKET_SECONDS = 86400


def _bucketed(log: DataFrame, bucket_seconds: int) -> DataFrame:
    return with_error_flag(log).withColumn("_b", F.floor(F.col("checked_ts") / bucket_seconds))


def consecutive_errors(log: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """+1 on error, reset on non-error.

    Two levels so a hot board is not one task: inside each (board, time bucket)
    a gaps-and-islands run count; across buckets a carry = the error run open at
    the end of the previous bucket, computed on one summary row per bucket
    (islands of buckets that start at a bucket containing a non-error)."""
    f = _bucketed(log, bucket_seconds)
    run = Window.partitionBy(*BOARD, "_b").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = f.withColumn("_grp", F.sum(1 - F.col("is_error")).over(run))
    wi = Window.partitionBy(*BOARD, "_b", "_grp").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = f.withColumn("_local", F.sum("is_error").over(wi))
    summ = f.groupBy(*BOARD, "_b").agg(
        F.max_by("_local", F.struct(*_order())).alias("_last_local"),
        F.max(1 - F.col("is_error")).alias("_has_ok"))
    wb = Window.partitionBy(*BOARD).orderBy("_b")
    wbr = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summ = summ.withColumn("_isl", F.sum("_has_ok").over(wbr))
    wisl = Window.partitionBy(*BOARD, "_isl").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summ = summ.withColumn("_end", F.sum("_last_local").over(wisl))
    summ = summ.select(*BOARD, "_b", F.coalesce(F.lag("_end").over(wb), F.lit(0)).alias("_carry"))
    f = f.join(summ, BOARD + ["_b"], "left")
    consec = F.when(F.col("_grp") == 0, F.col("_carry") + F.col("_local")).otherwise(F.col("_local"))
    return f.withColumn("consecutive_errors", consec.cast("int")).drop("_b", "_grp", "_local", "_carry")


def change_events(log: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """An event when the row is an error or differs from the board's previous row
    (status, detail with null = '', error flag); the first sighting always emits.

    The previous row comes from a window inside (board, time bucket); the first row
    of a bucket takes the last row of the board's previous non-empty bucket, found
    on one summary row per bucket."""
    f = _bucketed(log, bucket_seconds)
    w = Window.partitionBy(*BOARD, "_b").orderBy(*_order())
    det = F.coalesce(F.col("detail"), F.lit(""))
    f = f.select("*", det.alias("_det"), F.lag(F.struct(F.col("seq"), F.col("status"), det.alias("d"), F.col("is_error"))).over(w).alias("_prev"))
    last = f.groupBy(*BOARD, "_b").agg(
        F.max_by(F.struct(F.col("seq"), F.col("status"), F.col("_det").alias("d"), F.col("is_error")), F.struct(*_order())).alias("_last"))
    wb = Window.partitionBy(*BOARD).orderBy("_b")
    last = last.select(*BOARD, "_b", F.lag("_last").over(wb).alias("_before"))
    f = f.join(last, BOARD + ["_b"], "left").withColumn("_p", F.coalesce(F.col("_prev"), F.col("_before")))
    emit = (F.col("_p").isNull() | (F.col("is_error") == 1) | (F.col("_p.status") != F.col("status"))
            | (F.col("_p.d") != F.col("_det")) | (F.col("_p.is_error") != F.col("is_error")))
    return f.where(emit).select("seq", *BOARD, "status", "detail", "is_error", F.col("checked_ts").alias("created_ts"))


def source_status(log: DataFrame) -> DataFrame:
    """W3 (S9): latest row per board with carried last_ok_ts / last_error_ts and the
    trailing error run, computed with aggregations and a key join (skew-tolerant)."""
    f = with_error_flag(log)
    order = F.struct(F.col("checked_ts"), F.col("seq"))
    g = f.groupBy(*BOARD).agg(
        F.max_by(F.struct("status", "detail", "is_error"), order).alias("_last"),
        F.max("checked_ts").alias("last_checked_ts"),
        F.max(F.when(F.col("is_error") == 0, F.col("checked_ts"))).alias("last_ok_ts"),
        F.max(F.when(F.col("is_error") == 1, F.col("checked_ts"))).alias("last_error_ts"),
        F.max(F.when(F.col("is_error") == 0, order)).alias("_last_ok"),
    )
    trailing = (
        f.where(F.col("is_error") == 1).select(*BOARD, order.alias("_o"))
        .join(g.select(*BOARD, "_last_ok"), BOARD)
        .where(F.col("_last_ok").isNull() | (F.col("_o") > F.col("_last_ok")))
        .groupBy(*BOARD).agg(F.count(F.lit(1)).cast("int").alias("consecutive_errors"))
    )
    return g.join(trailing, BOARD, "left").select(
        *BOARD, F.col("_last.status").alias("status"), F.col("_last.detail").alias("detail"),
        F.col("_last.is_error").alias("is_error"), "last_checked_ts", "last_ok_ts", "last_error_ts",
        F.coalesce(F.col("consecutive_errors"), F.lit(0)).alias("consecutive_errors"),
    )


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Global top-N (T3, T6, T8, T9): TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def active_errors(status: DataFrame) -> DataFrame:
    """Boards currently in error."""
    return status.where(F.col("is_error") == 1).select(
        *BOARD, "status", "detail", "last_checked_ts", "last_error_ts", "consecutive_errors")


def service_error_ratio(status: DataFrame) -> DataFrame:
    """Per service sources, active errors, ratio (0 when empty)."""
    g = status.groupBy("service").agg(
        F.count(F.lit(1)).alias("sources_total"), F.sum("is_error").cast("long").alias("source_errors"))
    return g.withColumn("source_error_ratio", F.when(F.col("sources_total") > 0,
                                                     F.col("source_errors") / F.col("sources_total")).otherwise(F.lit(0.0)))


def json_summary(entries: Column) -> Column:
    """``json.dumps(summary, sort_keys=True)`` text from sorted (status, n) structs."""
    def key(e):
        k = F.regexp_replace(F.to_json(F.array(e["status"])), r"^\[|\]$", "")
        return F.concat(k, F.lit(": "), e["n"].cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, key), ", "), F.lit("}"))


def cycle_rollup(cycles: DataFrame) -> DataFrame:
    """A7/A9/A22 (S12 rows): one row per (service, cycle) with summary, status and counts.

    ``cycles`` holds (service, cycle_ts, status, n, duration_ms); entries per cycle are
    bounded by the number of distinct statuses.
    """
    err = P.is_error_status(F.col("status"))
    g = cycles.groupBy("service", "cycle_ts").agg(
        F.sort_array(F.collect_list(F.struct("status", "n"))).alias("_entries"),
        F.max(F.when(err & (F.col("n") > 0), F.lit(1)).otherwise(F.lit(0))).alias("_any_err"),
        F.sum(F.when(err, F.col("n")).otherwise(F.lit(0))).cast("long").alias("error_count"),
        F.sum(F.when(~err, F.col("n")).otherwise(F.lit(0))).cast("long").alias("ok_count"),
        F.max("duration_ms").alias("cycle_duration_ms"),
    )
    return g.select(
        "service", F.col("cycle_ts").alias("last_cycle_ts"),
        F.when(F.col("_any_err") == 1, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        json_summary(F.col("_entries")).alias("summary_json"),
        F.array_join(F.transform(F.col("_entries"), lambda e: F.concat(e["status"], F.lit(": "), e["n"].cast("string"))), ", ").alias("summary_text"),
        "error_count", "ok_count", "cycle_duration_ms",
    )


def summary_entries(history: DataFrame) -> DataFrame:
    """Stored summaries decoded again, one row per (service, cycle, status); a summary that isn't JSON gives no row."""
    decoded = F.from_json("summary_json", "map<string,bigint>")
    return history.select("service", F.col("last_cycle_ts").alias("cycle_ts"), F.explode(decoded).alias("status", "boards"))


def latest_cycle(history: DataFrame) -> DataFrame:
    """W9 (S11): latest cycle per service."""
    g = history.groupBy("service").agg(F.max_by(F.struct(*[c for c in history.columns if c != "service"]), "last_cycle_ts").alias("_c"))
    return g.select("service", *[F.col(f"_c.{c}").alias(c) for c in history.columns if c != "service"])


def cycle_status_counts(cycles: DataFrame) -> DataFrame:
    """Status -> boards for each (service, cycle)."""
    return cycles.groupBy("service", "cycle_ts", "status").agg(F.sum("n").cast("long").alias("boards"))


def history_window(history: DataFrame, n: int = R.HISTORY_WINDOW) -> DataFrame:
    """The newest n cycles globally (service, then ts breaks ties)."""
    return newest(history, n, F.desc("last_cycle_ts"), F.asc("service"))


def trend_points(history: DataFrame, n: int = R.TREND_POINTS) -> DataFrame:
    """W10 over the (bounded) history window: last n points per service."""
    w = Window.partitionBy("service").orderBy(F.desc("last_cycle_ts"))
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
