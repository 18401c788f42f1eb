"""Scrape series of the last known state.

A scrape sees every board's last outcome, polled or not since the scrape before.  The
outcomes of a board become steps: at the first scrape that sees a new state the board
joins its service (+1) and its error flag rises or falls (+1/-1).  The steps of a
service, summed per scrape and carried over days, give boards and errors at every
scrape without a row per board and scrape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsignal.operators import health as H

STEP = 15
DAY = 86400


def steps(log: DataFrame, step: int = STEP) -> DataFrame:
    """(service, tick, boards, errors): what changes at each scrape.

    Of a board's outcomes between two scrapes only the last is seen, so a board has at
    most one row per scrape before its rows are ordered."""
    tick = F.ceil(F.col("checked_ts") / step) * step
    seen = (H.with_error_flag(log).groupBy(*H.BOARD, tick.cast("long").alias("tick"))
            .agg(F.max_by("is_error", F.struct("checked_ts", "seq")).alias("is_error")))
    before = F.lag("is_error").over(Window.partitionBy(*H.BOARD).orderBy("tick"))
    moves = seen.select("service", "tick", before.isNull().cast("int").alias("boards"), (F.col("is_error") - F.coalesce(before, F.lit(0))).alias("errors"))
    return moves.groupBy("service", "tick").agg(F.sum("boards").alias("boards"), F.sum("errors").alias("errors"))


def scrape_series(log: DataFrame, step: int = STEP) -> DataFrame:
    """Boards, errors and their ratio at every scrape, from a service's first outcome to the last of all."""
    s = steps(log, step).withColumn("day", F.floor(F.col("tick") / DAY))
    end = s.agg(F.max("tick")).scalar()
    days = s.groupBy("service").agg(F.min("tick").alias("lo")).withColumn("hi", end)
    days = days.select("service", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / DAY), F.floor(F.col("hi") / DAY))).alias("day"))
    totals = s.groupBy("service", "day").agg(F.sum("boards").alias("b"), F.sum("errors").alias("e"))
    earlier = Window.partitionBy("service").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    carried = days.join(totals, ["service", "day"], "left").select(
        "service", "day", "lo", "hi", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("e0"))
    first = F.ceil(F.col("day") * DAY / step) * step
    ticks = carried.select("service", "day", "b0", "e0", F.explode(F.sequence(
        F.greatest("lo", first.cast("long")), F.least("hi", (F.col("day") + 1) * DAY - 1), F.lit(step).cast("long"))).alias("tick"))
    so_far = Window.partitionBy("service", "day").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ticks.join(s, ["service", "day", "tick"], "left")
    boards = (F.col("b0") + F.sum(F.coalesce("boards", F.lit(0))).over(so_far)).cast("long")
    errors = (F.col("e0") + F.sum(F.coalesce("errors", F.lit(0))).over(so_far)).cast("long")
    out = at.select("service", "tick", boards.alias("boards"), errors.alias("errors"))
    return out.withColumn("error_ratio", F.col("errors") / F.col("boards"))


def last_and_max(series: DataFrame, lookback: int) -> DataFrame:
    """Each service's last and greatest value over the look-back before the last scrape."""
    end = series.agg(F.max("tick")).scalar()
    recent = series.where(F.col("tick") >= end - lookback)
    return recent.groupBy("service").agg(
        *(F.max_by(c, "tick").alias(f"last_{c}") for c in ("errors", "error_ratio")), *(F.max(c).alias(f"max_{c}") for c in ("errors", "error_ratio")))
