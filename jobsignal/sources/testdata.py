"""Adapter views over the driver tables.

The driver tables hold no job postings, so each operator family reads a
view derived from them by the same definition in Spark and in DuckDB:

* ``v_postings``   documents     -> postings (title/location from fixed lists)
* ``v_status_log`` events        -> poll outcomes per (service, source)
* ``v_versions``   orders        -> posting versions per (provider, external id);
  title/location picked from the fixed lists by (custkey + priority digit)
  and (custkey + status index), so one key sees several content versions
* ``v_cycles``     v_status_log  -> hourly cycle summaries per service
* ``v_search_hits`` pages        -> search-result links
* ``v_html``       pages         -> raw HTML
* ``v_messages``   conversations -> alert message lines per turn

Reads are column-pruned: each view selects only the columns it needs, so
the parquet scan's ReadSchema stays narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions.text import q

# Adapter lists (positions 0..16 and 0..12).
TITLES = (
    "Software Engineer, New Grad - Backend Platform",
    "Senior Software Engineer",
    "Software Developer Intern",
    "Full Stack Engineer",
    "Front-End Developer",
    "Data Engineer",
    "Machine Learning Engineer",
    "Product Manager",
    "Account Executive, Sales",
    "Staff Platform Engineer",
    "Backend Engineer II",
    "iOS Developer",
    "Software Engineer I",
    "DevOps Engineer",
    "UX Designer",
    "Support Specialist",
    "Développeur Backend Engineer",
)
LOCATIONS = (
    "Remote - United States",
    "San Francisco, CA",
    "Hybrid - New York, NY",
    "London, United Kingdom",
    "Toronto, ON, Canada",
    "Remote",
    "Berlin, DE",
    "Milwaukee",
    "US",
    "Remote (US)",
    "",
    "Paris, Île-de-France",
    "Remote - Worldwide",
)
PROVIDERS = ("ashby", "greenhouse", "lever")
EVENT_STATUS = {"error": "error HTTP 500", "click": "ok", "purchase": "new match", "view": "unchanged (304)"}
OTHER_STATUS = "timeout"
CYCLE_SECONDS = R.CYCLE_SECONDS
#: Pages of one harvest run, by id.
RUN_PAGES = 2000


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal rows of a single-split input to ``spark.jobsignal.inputPartitions`` partitions by
    their unique key, for CPU-heavy work on one small file.  Off unless the setting is
    given (a scan of a large table has splits enough and must not shuffle whole texts)."""
    n = int(df.sparkSession.conf.get("spark.jobsignal.inputPartitions", "0"))
    return df.repartition(n, *key) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provider_of(c: Column) -> Column:
    return F.when(c % 3 == 0, F.lit("ashby")).when(c % 3 == 1, F.lit("greenhouse")).otherwise(F.lit("lever"))


def epoch_seconds(col_name: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col_name} AS TIMESTAMP_NTZ))")


def _pick(values, idx: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[idx.cast("int")]


def v_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return d.select(
        "doc_id",
        provider_of(F.col("doc_id")).alias("provider"),
        F.col("source").alias("company"),
        F.col("doc_id").cast("string").alias("external_job_id"),
        _pick(TITLES, F.col("doc_id") % len(TITLES)).alias("title"),
        _pick(LOCATIONS, F.col("doc_id") % len(LOCATIONS)).alias("location"),
        F.concat(F.lit("https://jobs.example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("description"),
    )


def v_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"), "event_id")
    status = F.lit(OTHER_STATUS)
    for k, v in reversed(list(EVENT_STATUS.items())):
        status = F.when(F.col("event_type") == k, F.lit(v)).otherwise(status)
    return e.select(
        F.col("event_id").alias("seq"),
        provider_of(F.col("user_id")).alias("service"),
        F.concat(F.lit("board-"), F.col("user_id").cast("string")).alias("source"),
        status.alias("status"),
        F.col("props").alias("detail"),
        epoch_seconds("ts").alias("checked_ts"),
    )


def _status_idx() -> Column:
    return F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)


def v_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "o_orderkey")
    company = F.concat(F.lit("co-"), (F.col("o_custkey") % 50).cast("string"))
    ext = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        provider_of(F.col("o_custkey")).alias("provider"),
        ext.alias("external_job_id"),
        company.alias("company"),
        _pick(TITLES, (F.col("o_custkey") + F.substring("o_orderpriority", 1, 1).cast("int")) % len(TITLES)).alias("title"),
        _pick(LOCATIONS, (F.col("o_custkey") + _status_idx()) % len(LOCATIONS)).alias("location"),
        F.concat(F.lit("https://jobs.example.org/"), company, F.lit("/"), ext).alias("url"),
        F.lit("").alias("description"),
        epoch_seconds("o_orderdate").alias("observed_ts"),
    )


def v_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    s = v_status_log(spark, sf_dir).select(
        "service", "status", "checked_ts", (F.col("checked_ts") - F.col("checked_ts") % CYCLE_SECONDS).alias("cycle_ts")
    )
    g = s.groupBy("service", "cycle_ts", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("checked_ts").alias("_lo"), F.max("checked_ts").alias("_hi")
    )
    w = W.partitionBy("service", "cycle_ts")  # rows per window = distinct statuses (bounded)
    return g.select(
        "service", "cycle_ts", "status", "n",
        ((F.max("_hi").over(w) - F.min("_lo").over(w)) * 1000).alias("duration_ms"),
    )


def v_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a hit of one harvest run; a run's hits of a platform and query fill result pages of ten."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "pages").select("page_id", "url")
    p = p.select("page_id", F.floor(F.col("page_id") / RUN_PAGES).alias("run"),
                 F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("platform"), (F.col("page_id") % 3).alias("query_idx"), "url")
    n = F.row_number().over(W.partitionBy("run", "platform", "query_idx").orderBy("page_id")).cast("long") - 1   # at most RUN_PAGES rows
    return p.select("run", "platform", "query_idx", (n - n % 10).alias("start"), (n % 10).alias("pos"), F.col("url").alias("link"))


def v_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


def v_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return c.select("conv_id", "turn", F.split(F.col("text"), "\n", -1).alias("lines"))


SPARK_VIEWS = {
    "v_postings": v_postings,
    "v_status_log": v_status_log,
    "v_versions": v_versions,
    "v_cycles": v_cycles,
    "v_search_hits": v_search_hits,
    "v_html": v_html,
    "v_messages": v_messages,
}

# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------


def _p3(c: str) -> str:
    return f"CASE {c} % 3 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' ELSE 'lever' END"


def _case(c: str, n: int, values) -> str:
    return f"CASE {c} % {n} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def _sec(c: str) -> str:
    return f"(epoch_us({c}) // 1000000)"


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EVENT_STATUS.items()) + f" ELSE {q(OTHER_STATUS)} END"

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_postings": ((), f"""SELECT doc_id, {_p3('doc_id')} AS provider, source AS company,
        CAST(doc_id AS VARCHAR) AS external_job_id, {_case('doc_id', len(TITLES), TITLES)} AS title,
        {_case('doc_id', len(LOCATIONS), LOCATIONS)} AS location,
        'https://jobs.example.org/' || source || '/' || CAST(doc_id AS VARCHAR) AS url, text AS description
        FROM documents"""),
    "v_status_log": ((), f"""SELECT event_id AS seq, {_p3('user_id')} AS service,
        'board-' || CAST(user_id AS VARCHAR) AS source, {_STATUS_SQL} AS status, props AS detail,
        {_sec('ts')} AS checked_ts FROM events"""),
    "v_versions": ((), f"""SELECT o_orderkey AS seq, {_p3('o_custkey')} AS provider,
        CAST(o_custkey AS VARCHAR) AS external_job_id, 'co-' || CAST(o_custkey % 50 AS VARCHAR) AS company,
        {_case("(o_custkey + CAST(substring(o_orderpriority, 1, 1) AS INTEGER))", len(TITLES), TITLES)} AS title,
        {_case("(o_custkey + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)", len(LOCATIONS), LOCATIONS)} AS location,
        'https://jobs.example.org/co-' || CAST(o_custkey % 50 AS VARCHAR) || '/' || CAST(o_custkey AS VARCHAR) AS url,
        '' AS description, {_sec('o_orderdate')} AS observed_ts FROM orders"""),
    "v_cycles": (("v_status_log",), f"""SELECT service, cycle_ts, status, n,
        (max(_hi) OVER (PARTITION BY service, cycle_ts) - min(_lo) OVER (PARTITION BY service, cycle_ts)) * 1000 AS duration_ms
        FROM (SELECT service, checked_ts - checked_ts % {CYCLE_SECONDS} AS cycle_ts, status, count(*) AS n,
              min(checked_ts) AS _lo, max(checked_ts) AS _hi FROM v_status_log GROUP BY 1, 2, 3) g"""),
    "v_search_hits": ((), f"""SELECT run, platform, query_idx, n - n % 10 AS start, n % 10 AS pos, url AS link FROM (
        SELECT *, row_number() OVER (PARTITION BY run, platform, query_idx ORDER BY page_id) - 1 AS n FROM (
          SELECT page_id, page_id // {RUN_PAGES} AS run, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS platform, page_id % 3 AS query_idx, url FROM pages) p) h"""),
    "v_html": ((), "SELECT page_id, html FROM pages"),
    "v_messages": ((), "SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations"),
}


def with_views(views, body: str, ctes=()) -> str:
    """Render ``WITH <views and ctes> <body>`` for DuckDB, resolving view dependencies."""
    order: list[str] = []

    def add(v):
        if v in order:
            return
        for dep in SQL_VIEWS[v][0]:
            add(dep)
        order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({SQL_VIEWS[v][1]})" for v in order] + [f"{n} AS ({s})" for n, s in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
