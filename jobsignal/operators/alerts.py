"""Alert selection and message building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsignal import rules as R


def posting_url(provider: Column, company: Column, job_id: Column, apply_url: Column | None = None) -> Column:
    """Canonical posting URL per provider (Lever prefers applyUrl)."""
    lever_apply = F.lit(None).cast("string") if apply_url is None else F.nullif(apply_url, F.lit(""))
    return (
        F.when(provider == "ashby", F.concat(F.lit(f"https://{R.HOSTS['ashby']}/"), company, F.lit("/"), job_id))
        .when(provider == "greenhouse", F.concat(F.lit(f"https://{R.HOSTS['greenhouse']}/"), company, F.lit("/jobs/"), job_id))
        .otherwise(F.coalesce(lever_apply, F.concat(F.lit(f"https://{R.HOSTS['lever']}/"), company, F.when(F.coalesce(job_id, F.lit("")) != "", F.concat(F.lit("/"), job_id)).otherwise(F.lit("")))))
    )


from pyspark.sql import DataFrame, Window  # noqa: E402

from jobsignal.functions import predicates as P  # noqa: E402
from jobsignal.functions import text as X  # noqa: E402

BOARD = ["service", "source"]
ID = BOARD + ["external_job_id"]


def deterministic_matches(obs: DataFrame, level_gate: bool = False) -> DataFrame:
    """title rule, non-empty id and US location."""
    cond = (P.title_matches(F.col("title"), level_gate) & P.nonempty_id(F.col("external_job_id"))
            & P.is_us_location(F.col("location")))
    return P.fenced_where(obs, cond)


def response_dedupe(obs: DataFrame, response: list[str], pos: str = "seq") -> DataFrame:
    """Inside one response the last occurrence of an id wins (Greenhouse, Lever);
    Ashby keeps every posting."""
    w = Window.partitionBy(*response, "external_job_id").orderBy(F.desc(pos))
    ranked = obs.withColumn("_rn", F.row_number().over(w))
    return ranked.where((F.col("service") == "ashby") | (F.col("_rn") == 1)).drop("_rn")


def first_alerts(matches: DataFrame, ts: str = "observed_ts") -> DataFrame:
    """The first matching observation of each (board, id) alerts; later ones never do.

    An aggregation (partial per task), so a hot board does not pile into one task."""
    cols = [c for c in matches.columns if c not in ID]
    g = matches.groupBy(*ID).agg(F.min_by(F.struct(*cols), F.struct(F.col(ts), F.col("seq"))).alias("_f"))
    return g.select(*ID, *[F.col(f"_f.{c}").alias(c) for c in cols]).withColumnRenamed(ts, "first_alert_ts")


def unnotified(current: DataFrame, notified: DataFrame) -> DataFrame:
    """Current ids not yet in the notified set."""
    return current.join(notified.select(*ID).distinct(), ID, "left_anti")


def notified_union(notified: DataFrame, new_matches: DataFrame) -> DataFrame:
    """Every new match joins the notified set (also those cut by the message top-N)."""
    return notified.select(*ID).unionByName(new_matches.select(*ID)).distinct()


def ranked_alerts(first: DataFrame) -> DataFrame:
    """T11-T13 in one window: rank inside (board, cycle) by the provider's order, and whether a message shows it.

    Greenhouse orders by numeric id, Lever by (updatedAt or 0, id), Ashby by response order."""
    svc = F.col("service")
    number = F.when(svc == "greenhouse", F.col("external_job_id").try_cast("long")).when(svc == "lever", F.coalesce("updated_ms", F.lit(0)))
    text = F.when(svc == "lever", F.coalesce("external_job_id", F.lit("")))
    w = Window.partitionBy("service", "source", "first_alert_ts").orderBy(number.asc_nulls_first(), text, "seq")
    limit = F.when(svc == "ashby", R.ALERT_LIMIT_ASHBY).otherwise(R.ALERT_LIMIT_BOARD)
    return first.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("shown", F.col("rank") <= limit)


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def provider_order(service: str) -> list[Column]:
    """Per-provider alert order: Greenhouse id asc; Lever (updatedAt or 0, id); Ashby response order."""
    if service == "greenhouse":
        return [F.col("external_job_id").cast("long").asc_nulls_first(), F.col("seq")]
    if service == "lever":
        return [F.coalesce(F.col("updated_ms"), F.lit(0)), F.coalesce(F.col("external_job_id"), F.lit("")), F.col("seq")]
    return [F.col("seq")]


def alert_line(service: Column, source: Column, title: Column, job_id: Column, apply_url: Column) -> Column:
    """P16 line for one job; null when the job lacks a title or a link."""
    t = X.strip_ws(F.coalesce(title, F.lit("")))
    url = posting_url(service, source, job_id, apply_url)
    ashby = F.when((t != "") & (F.coalesce(job_id, F.lit("")) != ""), F.concat(t, F.lit(" - "), url))
    board = F.when((t != "") & (F.coalesce(job_id, F.lit("")) != ""), F.concat(t, F.lit(" | "), url))
    lever = F.when((t != "") & (F.coalesce(url, F.lit("")) != ""), F.concat(t, F.lit(" | "), url))
    return F.when(service == "ashby", ashby).when(service == "lever", lever).otherwise(board)


def alert_header(service: Column, source: Column) -> Column:
    return (F.when(service == "ashby", F.concat(F.lit("["), source, F.lit("]")))
            .when(service == "greenhouse", F.concat(F.lit(f"Board: https://{R.HOSTS['greenhouse']}/"), source))
            .otherwise(F.concat(F.lit(f"Board: https://{R.HOSTS['lever']}/"), source)))


def chunk_lines(lines: Column, max_len: int = R.MESSAGE_MAX_LEN) -> Column:
    """Greedy packing of lines into chunks of at most ``max_len`` characters
    (an over-long line stays whole; an overflow flushes even an empty chunk)."""
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, line):
        flush = F.length(acc["cur"]) + F.length(line) + 1 > max_len
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit("\n"), line)).otherwise(line)
        return F.struct(
            F.when(flush, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(flush, line).otherwise(joined).alias("cur"),
        )

    return F.aggregate(lines, init, step,
                       lambda acc: F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))


def message_lines(first: DataFrame) -> DataFrame:
    """The lines of each board's message of a cycle: header, then the alerts that are shown."""
    top = ranked_alerts(first).where(F.col("rank") <= R.ALERT_LIMIT_ASHBY).where("shown")
    top = top.withColumn("line", alert_line(F.col("service"), F.col("source"), F.col("title"), F.col("external_job_id"), F.col("url")))
    g = top.groupBy("service", "source", F.col("first_alert_ts").alias("cycle_ts")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    body = F.filter(F.transform(F.col("_l"), lambda e: e["line"]), lambda x: x.isNotNull())
    return g.select("service", "source", "cycle_ts",
                    F.concat(F.array(alert_header(F.col("service"), F.col("source"))), body).alias("lines"))


def chunks(messages: DataFrame) -> DataFrame:
    """One row per chunk of each message."""
    m = messages.select("service", "source", "cycle_ts", chunk_lines(F.col("lines")).alias("chunks"))
    return m.select("service", "source", "cycle_ts", F.posexplode("chunks").alias("pos", "text")).select(
        "service", "source", "cycle_ts", (F.col("pos") + 1).cast("long").alias("chunk_no"), "text")


def classified_messages(entries: DataFrame, n: int) -> DataFrame:
    """P17 + T10: one message per (provider, company): the board's header, then its ``n`` best jobs."""
    board = ["provider", "company"]
    top = top_n(entries, board, [F.desc("relevance_score"), F.col("doc_id")], n)
    shown = classified_entry_lines(*[F.col(c) for c in ("relevance_score", "company", "company", "title", "role_type",
                                                         "seniority", "location_fit", "location", "reason", "url")])
    of_board = top.select(*board, "rank", shown.alias("ls")).groupBy(*board).agg(
        F.sort_array(F.collect_list(F.struct("rank", "ls"))).alias("_e"))   # at most n entries
    body = F.flatten(F.transform("_e", lambda e: e["ls"]))
    header = alert_header(F.col("provider"), F.col("company"))
    return of_board.select(F.col("provider").alias("service"), F.col("company").alias("source"),
                           F.array_join(F.concat(F.array(header), body), "\n").alias("message"))


def classified_entry_lines(score: Column, company: Column, source: Column, title: Column, role_type: Column,
                           seniority: Column, fit: Column, location: Column, reason: Column, url: Column) -> Column:
    """The 3-4 lines of one classified job, with the display defaults."""
    def nz(c, d):
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(d)).otherwise(c)
    lines = F.array(
        F.concat(score.cast("string"), F.lit("/100 | "), F.when(F.coalesce(company, F.lit("")) == "", source).otherwise(company),
                 F.lit(" | "), nz(title, "Untitled role")),
        F.concat_ws(" | ", F.coalesce(role_type, F.lit("other")), F.coalesce(seniority, F.lit("unknown")),
                    F.coalesce(fit, F.lit("unclear")), nz(location, "Unknown location")),
        F.concat(F.lit("Why: "), nz(reason, "No explanation returned.")),
    )
    return F.when(F.coalesce(url, F.lit("")) != "", F.array_append(lines, url)).otherwise(lines)
