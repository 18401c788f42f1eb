"""Log-line source (S17) and structured log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsignal import rules as R


def iso_utc(ts: Column) -> Column:
    """Python ``datetime.isoformat()`` with 'Z': fraction only when microseconds != 0."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1000000
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def log_row(ts: Column, level: str, service: Column, event: Column, fields: list[tuple[str, Column]]) -> Column:
    """JSON log object; null fields dropped, base-name clashes prefixed ``field_``."""
    named = [(f"field_{k}" if k in R.SHORT_LOG_FIELDS else k, v) for k, v in fields]
    return F.to_json(F.struct(iso_utc(ts).alias("timestamp"), F.lit(level).alias("level"), service.alias("service"),
                              event.alias("event"), *[v.alias(k) for k, v in named]))


def triage(lines: DataFrame, child: Column, supervisor: str = "supervisor") -> DataFrame:
    """Blank lines dropped; a JSON object passes through; anything else is wrapped as
    a ``subprocess_output`` log row with the child's name and the text."""
    text = F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), f"{R.WS}+$", "")
    t = lines.select("seq", "ts", child.alias("child"), text.alias("text")).where(F.col("text") != "")
    is_obj = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col("text"))).startswith("OBJECT"), F.lit(False))
    wrapped = log_row(F.col("ts"), "INFO", F.lit(supervisor), F.lit("subprocess_output"),
                      [("child_service", F.col("child")), ("message", F.col("text"))])
    return t.select("seq", F.when(is_obj, F.lit("passthrough")).otherwise(F.lit("wrapped")).alias("kind"),
                    F.when(is_obj, F.col("text")).otherwise(wrapped).alias("out"))
