"""Streams with an event-time watermark (R9) and with state that expires.

Unlike the job, status and alert tables, these keep only what the watermark leaves
open: hours that can still change, and ids whose TTL runs.  The state is Spark's own
(on a cluster set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB
store, so that it need not fit in the executors' memory); results are committed by
manifest like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.operators import alerts as A
from jobsignal.streaming.pipeline import _run, _scratch, land_slices
from jobsignal.streaming.state import State

DELAY = 86400
WINDOW = 3600
#: With a single stateful operator the rows that count as late are those behind the watermark that closes windows.
ONE_WATERMARK = "spark.sql.streaming.statefulOperator.allowMultiple"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _timed(rows: DataFrame, ts: str, delay: int) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", f"{delay} seconds")


def poll_windows_stream(spark: SparkSession, log: DataFrame, cuts: list[int], late: DataFrame | None = None, root: str | None = None,
                        delay: int = DELAY, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(closed windows, late rows) of a poll log that lands slice by slice.

    A window (service, status, start, polls) is appended once, when the newest time seen
    is ``delay`` past its end.  A row whose window has closed before its micro-batch is
    not counted; it is in the late table with the number of that micro-batch.  Every row
    is in exactly one of: a closed window, a window still open, the late table."""
    root = root or _scratch(spark, "windows")
    landing = f"{root}/landing"
    land_slices(log, landing, "checked_ts", cuts)
    if late is not None:
        late.write.mode("overwrite").parquet(f"{landing}/slice=9999")
    closed = State(spark, f"{root}/closed", {})
    behind = State(spark, f"{root}/behind", {"clock": ["id"]}, buckets=1)

    def count(rows: DataFrame) -> DataFrame:
        return (_timed(rows, "checked_ts", delay).groupBy(F.window("event_time", f"{window} seconds"), "service", "status")
                .agg(F.count(F.lit(1)).alias("polls")))

    def append(batch: DataFrame, batch_id: int) -> None:
        if b := closed.begin(batch_id):
            b.append("windows", batch.select("service", "status", F.col("window.start").cast("long").alias("window_start"), "polls"))
            b.commit()

    def judge(batch: DataFrame, batch_id: int) -> None:
        if b := behind.begin(batch_id):
            clock = b.read("clock", [0])
            now = clock.first()["newest"] if clock is not None else None  # one row: the newest time of all batches before
            ends = F.col("checked_ts") - F.pmod(F.col("checked_ts"), F.lit(window)) + window
            b.append("late", batch.where(F.lit(now is not None) & (ends <= F.lit(now or 0) - delay)).withColumn("batch", F.lit(batch_id).cast("long")))
            newest = batch.agg(F.max("checked_ts").alias("newest")).select(F.lit(0).alias("id"), F.greatest("newest", F.lit(now).cast("long")).alias("newest"))
            b.write("clock", newest.where("newest is not null"), [0])
            b.commit()

    with _setting(spark, ONE_WATERMARK, "false"):
        _run(spark, log.schema, landing, f"{root}/chk-windows", append, count)
    _run(spark, log.schema, landing, f"{root}/chk-late", judge)
    return closed.read("windows"), behind.read("late")


def alerts_ttl_stream(spark: SparkSession, observations: DataFrame, cuts: list[int], ttl: int, root: str | None = None) -> DataFrame:
    """R4 with a TTL: an id that has alerted alerts again only after the stream has moved ``ttl`` seconds past it.

    The first step leaves, of each micro-batch, the first match per id; the second drops ids
    whose state is alive (``dropDuplicatesWithinWatermark``), so the state holds the ids of one
    TTL and not of all time.  Where the TTL covers the data the alerts are those of W12."""
    root = root or _scratch(spark, "alerts-ttl")
    land_slices(observations, f"{root}/landing", "observed_ts", cuts)
    out = State(spark, f"{root}/alerts", {})

    def reduce(batch: DataFrame, batch_id: int) -> None:
        firsts = A.first_alerts(A.deterministic_matches(batch))
        firsts.write.mode("overwrite").parquet(f"{root}/firsts/slice={batch_id:06d}")

    def append(batch: DataFrame, batch_id: int) -> None:
        if b := out.begin(batch_id):
            b.append("alerts", batch.drop("event_time"))
            b.commit()

    _run(spark, observations.schema, f"{root}/landing", f"{root}/chk-firsts", reduce)
    schema = spark.read.parquet(f"{root}/firsts").drop("slice").schema
    _run(spark, schema, f"{root}/firsts", f"{root}/chk-alerts", append, lambda rows: _timed(rows, "first_alert_ts", ttl).dropDuplicatesWithinWatermark(A.ID))
    return out.read("alerts")
