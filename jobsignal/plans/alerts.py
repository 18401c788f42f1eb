"""Alert queries: matches, alert-once state, top-N, messages and chunks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.operators import alerts as A
from jobsignal.operators import classify as C
from jobsignal.plans.registry import register
from jobsignal.sources.testdata import v_messages, v_postings, v_versions, with_views

CUTOFF_TS = 883612800  # observations before this are the already-notified state
ID = "service, source, external_job_id"
MATCH = (f"{P.sql.title_matches('title')} AND {P.sql.nonempty_id('external_job_id')} AND {P.sql.is_us_location('location')}")
CTES = {
    "obs": ("SELECT provider AS service, company AS source, external_job_id, seq, observed_ts, title, location, url, "
            "observed_ts * 1000 AS updated_ms FROM v_versions"),
    "m": f"SELECT * FROM obs WHERE {MATCH}",
    "fa": (f"SELECT service, source, external_job_id, seq, observed_ts AS first_alert_ts, title, location, url, updated_ms FROM "
           f"(SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY observed_ts, seq) AS _rn FROM m) x WHERE _rn = 1"),
    "notified": f"SELECT {ID} FROM fa WHERE first_alert_ts < {CUTOFF_TS}",
    "batch": f"SELECT * FROM m WHERE observed_ts >= {CUTOFF_TS}",
}
DEPS = {"m": ["obs"], "fa": ["obs", "m"], "notified": ["obs", "m", "fa"], "batch": ["obs", "m"]}


def asql(body: str, *names: str) -> str:
    order: list[str] = []
    for n in names:
        for d in DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    return with_views(["v_versions"], body, [(n, CTES[n]) for n in order])


def observations(spark, sf):
    v = v_versions(spark, sf)
    return v.select(F.col("provider").alias("service"), F.col("company").alias("source"), "external_job_id", "seq",
                    "observed_ts", "title", "location", "url", (F.col("observed_ts") * 1000).alias("updated_ms"))


def _matches(spark, sf):
    return A.deterministic_matches(observations(spark, sf))


def _first(spark, sf):
    return A.first_alerts(_matches(spark, sf))


def _notified(spark, sf):
    return _first(spark, sf).where(F.col("first_alert_ts") < CUTOFF_TS).select(*A.ID)


@register("response_dedupe", ids="W7",
          sql=lambda: asql("""SELECT service, source, external_job_id, seq FROM (SELECT *, row_number() OVER
              (PARTITION BY service, source, observed_ts, external_job_id ORDER BY seq DESC) AS _rn FROM obs) x
              WHERE service = 'ashby' OR _rn = 1""", "obs"))
def response_dedupe(spark, sf):
    d = A.response_dedupe(observations(spark, sf), ["service", "source", "observed_ts"])
    return d.select("service", "source", "external_job_id", "seq")


@register("ashby_matches", ids="P11 F6 P12",
          sql=lambda: asql("""SELECT source AS company, title, external_job_id AS id,
              'https://jobs.ashbyhq.com/' || source || '/' || external_job_id AS url, location,
              """ + __import__("jobsignal.functions.text", fromlist=["sql"]).sql.ashby_workplace("NULL", "location") + """ AS work_type
              FROM m WHERE service = 'ashby'""", "m"))
def ashby_matches(spark, sf):
    from jobsignal.functions import text as X

    m = _matches(spark, sf).where(F.col("service") == "ashby")
    return m.select(F.col("source").alias("company"), "title", F.col("external_job_id").alias("id"),
                    A.posting_url(F.col("service"), F.col("source"), F.col("external_job_id")).alias("url"), "location",
                    X.ashby_workplace(F.lit(None).cast("string"), F.col("location")).alias("work_type"))


@register("first_alerts", ids="W12 R4",
          sql=lambda: asql("SELECT service, source, external_job_id, first_alert_ts, seq, title FROM fa", "fa"))
def first_alerts(spark, sf):
    return _first(spark, sf).select("service", "source", "external_job_id", "first_alert_ts", "seq", "title")


@register("unnotified", ids="J3",
          sql=lambda: asql(f"SELECT DISTINCT {ID} FROM batch b WHERE NOT EXISTS (SELECT 1 FROM notified n WHERE "
                           "n.service = b.service AND n.source = b.source AND n.external_job_id = b.external_job_id)", "batch", "notified"))
def unnotified(spark, sf):
    batch = _matches(spark, sf).where(F.col("observed_ts") >= CUTOFF_TS)
    return A.unnotified(batch.select(*A.ID), _notified(spark, sf)).distinct()


@register("notified_union", ids="U2 S13",
          sql=lambda: asql(f"SELECT {ID} FROM notified UNION SELECT {ID} FROM batch", "notified", "batch"))
def notified_union(spark, sf):
    batch = _matches(spark, sf).where(F.col("observed_ts") >= CUTOFF_TS)
    return A.notified_union(_notified(spark, sf), batch)


@register("ids_except_notified", ids="U3",
          sql=lambda: asql(f"SELECT {ID} FROM obs WHERE observed_ts >= {CUTOFF_TS} EXCEPT SELECT {ID} FROM notified", "obs", "notified"))
def ids_except_notified(spark, sf):
    cur = observations(spark, sf).where(F.col("observed_ts") >= CUTOFF_TS).select(*A.ID)
    return cur.subtract(_notified(spark, sf))


def _top_sql(service: str, order: str, n: int) -> str:
    return asql(f"""SELECT service, source, first_alert_ts AS cycle_ts, external_job_id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY service, source, first_alert_ts ORDER BY {order}) AS rank FROM fa
        WHERE service = '{service}') x WHERE rank <= {n}""", "fa")


def _top(spark, sf, service: str, n: int):
    fa = _first(spark, sf).where(F.col("service") == service)
    t = A.top_n(fa, ["service", "source", "first_alert_ts"], A.provider_order(service), n)
    return t.select("service", "source", F.col("first_alert_ts").alias("cycle_ts"), "external_job_id", "rank")


@register("alert_top_greenhouse", ids="T11",
          sql=lambda: _top_sql("greenhouse", "CAST(external_job_id AS BIGINT) NULLS FIRST, seq", R.ALERT_LIMIT_BOARD))
def alert_top_greenhouse(spark, sf):
    return _top(spark, sf, "greenhouse", R.ALERT_LIMIT_BOARD)


@register("alert_top_lever", ids="T12",
          sql=lambda: _top_sql("lever", "coalesce(updated_ms, 0), coalesce(external_job_id, ''), seq", R.ALERT_LIMIT_BOARD))
def alert_top_lever(spark, sf):
    return _top(spark, sf, "lever", R.ALERT_LIMIT_BOARD)


@register("alert_top_ashby", ids="T13",
          sql=lambda: _top_sql("ashby", "seq", R.ALERT_LIMIT_ASHBY))
def alert_top_ashby(spark, sf):
    return _top(spark, sf, "ashby", R.ALERT_LIMIT_ASHBY)


_ORDER_SQL = ("CASE service WHEN 'greenhouse' THEN row_number() OVER (PARTITION BY service, source, first_alert_ts "
              "ORDER BY CAST(external_job_id AS BIGINT) NULLS FIRST, seq) "
              "WHEN 'lever' THEN row_number() OVER (PARTITION BY service, source, first_alert_ts ORDER BY coalesce(updated_ms, 0), "
              "coalesce(external_job_id, ''), seq) ELSE row_number() OVER (PARTITION BY service, source, first_alert_ts ORDER BY seq) END")
_LINE_SQL = ("CASE WHEN trim(coalesce(title, '')) = '' OR coalesce(external_job_id, '') = '' THEN NULL "
             "WHEN service = 'ashby' THEN trim(title) || ' - https://jobs.ashbyhq.com/' || source || '/' || external_job_id "
             "WHEN service = 'greenhouse' THEN trim(title) || ' | https://boards.greenhouse.io/' || source || '/jobs/' || external_job_id "
             "ELSE trim(title) || ' | ' || coalesce(NULLIF(url, ''), 'https://jobs.lever.co/' || source || '/' || external_job_id) END")
_HEADER_SQL = ("CASE service WHEN 'ashby' THEN '[' || source || ']' WHEN 'greenhouse' THEN 'Board: https://boards.greenhouse.io/' || source "
               "ELSE 'Board: https://jobs.lever.co/' || source END")
_MSG_LINES_SQL = f"""SELECT service, source, first_alert_ts AS cycle_ts,
    list_prepend(any_value({_HEADER_SQL}), list(line ORDER BY rank) FILTER (WHERE line IS NOT NULL)) AS lines
    FROM (SELECT *, {_ORDER_SQL} AS rank, {_LINE_SQL} AS line FROM fa) x
    WHERE rank <= CASE service WHEN 'ashby' THEN {R.ALERT_LIMIT_ASHBY} ELSE {R.ALERT_LIMIT_BOARD} END
    GROUP BY service, source, first_alert_ts"""


def _message_lines(spark, sf):
    return A.message_lines(_first(spark, sf))


@register("alert_lines", ids="P16 T11-T13",
          sql=lambda: with_views(["v_versions"], f"SELECT service, source, cycle_ts, array_to_string(lines, chr(10)) AS message FROM ({_MSG_LINES_SQL}) x",
                                 [(n, CTES[n]) for n in ("obs", "m", "fa")]))
def alert_lines(spark, sf):
    return _message_lines(spark, sf).select("service", "source", "cycle_ts", F.array_join("lines", "\n").alias("message"))


def _chunk_sql(lines: str, max_len: int = R.MESSAGE_MAX_LEN) -> str:
    red = (f"list_reduce({lines}, lambda acc, line: CASE WHEN length(acc.cur) + length(line) + 1 > {max_len} "
           f"THEN struct_pack(done := list_append(acc.done, acc.cur), cur := line) "
           f"ELSE struct_pack(done := acc.done, cur := CASE WHEN acc.cur <> '' THEN acc.cur || chr(10) || line ELSE line END) END, "
           f"struct_pack(done := CAST([] AS VARCHAR[]), cur := ''))")
    return f"(CASE WHEN ({red}).cur <> '' THEN list_append(({red}).done, ({red}).cur) ELSE ({red}).done END)"


@register("message_chunks", ids="W13",
          sql=lambda: with_views(["v_messages"], f"""SELECT conv_id, turn, generate_subscripts(chunks, 1) AS chunk_no, unnest(chunks) AS text
              FROM (SELECT conv_id, turn, {_chunk_sql('lines')} AS chunks FROM v_messages) x"""))
def message_chunks(spark, sf):
    m = v_messages(spark, sf).select("conv_id", "turn", A.chunk_lines(F.col("lines")).alias("chunks"))
    return m.select("conv_id", "turn", F.posexplode("chunks").alias("pos", "text")).select(
        "conv_id", "turn", (F.col("pos") + 1).cast("long").alias("chunk_no"), "text")


@register("sink_alerts", ids="S14 W13 P16",
          sql=lambda: with_views(["v_versions"], f"""SELECT service, source, cycle_ts, generate_subscripts(chunks, 1) AS chunk_no, unnest(chunks) AS text
              FROM (SELECT service, source, cycle_ts, {_chunk_sql('lines')} AS chunks FROM ({_MSG_LINES_SQL}) y) x""",
                                 [(n, CTES[n]) for n in ("obs", "m", "fa")]))
def sink_alerts(spark, sf):
    return A.chunks(_message_lines(spark, sf))


@register("sink_alert_items", ids="S14 T11-T13",
          sql=lambda: with_views(["v_versions"], f"""SELECT service, source, first_alert_ts AS cycle_ts, external_job_id, rank,
              rank <= CASE service WHEN 'ashby' THEN {R.ALERT_LIMIT_ASHBY} ELSE {R.ALERT_LIMIT_BOARD} END AS shown
              FROM (SELECT *, {_ORDER_SQL} AS rank FROM fa) x""", [(n, CTES[n]) for n in ("obs", "m", "fa")]))
def sink_alert_items(spark, sf):
    """Every alert is stored; the message limits only decide which are ``shown``."""
    return A.ranked_alerts(_first(spark, sf)).select("service", "source", F.col("first_alert_ts").alias("cycle_ts"), "external_job_id", "rank", "shown")


# --- classified (relevance) alert path ------------------------------------------------------

TH = R.clamp_threshold(R.DEFAULT_MIN_RELEVANCE_SCORE)
_CLS = lambda: C.sql_classify("v_postings")


@register("alert_candidates", ids="F16 F8 F6",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, company, relevance_score FROM ({_CLS()}) c WHERE relevance_score >= {TH}"))
def alert_candidates(spark, sf, rules: R.Rules = R.DEFAULT_RULES):
    p = v_postings(spark, sf)
    if rules.classification_enabled:
        c = C.classify(p).withColumn("_ok", F.col("relevance_score") >= TH)
        return c.where("_ok").select("doc_id", "company", "relevance_score")
    return A.deterministic_matches(p).select("doc_id", "company", F.lit(None).cast("int").alias("relevance_score"))


@register("ranked_alerts", ids="T10",
          sql=lambda: with_views(["v_postings"], f"""SELECT company, doc_id, relevance_score, rank FROM (
              SELECT *, row_number() OVER (PARTITION BY company ORDER BY relevance_score DESC, doc_id) AS rank
              FROM ({_CLS()}) c WHERE relevance_score >= {TH}) x WHERE rank <= {R.ALERT_LIMIT_BOARD}"""))
def ranked_alerts(spark, sf):
    c = C.classify(v_postings(spark, sf)).withColumn("_ok", F.col("relevance_score") >= TH).where("_ok")
    t = A.top_n(c, ["company"], [F.desc("relevance_score"), F.col("doc_id")], R.ALERT_LIMIT_BOARD)
    return t.select("company", "doc_id", "relevance_score", "rank")


@register("classified_alert_lines", ids="P17 T10",
          sql=lambda: with_views(["v_postings"], f"""SELECT company AS source, '[' || company || ']' || chr(10) ||
              string_agg(array_to_string(ls, chr(10)), chr(10) ORDER BY rank) AS message FROM (
                SELECT company, rank, [CAST(relevance_score AS VARCHAR) || '/100 | ' || company || ' | ' || title,
                        role_type || ' | ' || seniority || ' | ' || location_fit || ' | ' || CASE WHEN location = '' THEN 'Unknown location' ELSE location END,
                        'Why: ' || reason] || CASE WHEN url <> '' THEN [url] ELSE CAST([] AS VARCHAR[]) END AS ls
                FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY relevance_score DESC, doc_id) AS rank
                      FROM ({_CLS()}) c WHERE relevance_score >= {TH}) r WHERE rank <= {R.ALERT_LIMIT_BOARD}) y
              GROUP BY company"""))
def classified_alert_lines(spark, sf):
    c = C.classify(v_postings(spark, sf)).withColumn("_ok", F.col("relevance_score") >= TH).where("_ok")
    t = A.top_n(c, ["company"], [F.desc("relevance_score"), F.col("doc_id")], R.ALERT_LIMIT_BOARD)
    t = t.withColumn("ls", A.classified_entry_lines(F.col("relevance_score"), F.col("company"), F.col("company"), F.col("title"),
                                                    F.col("role_type"), F.col("seniority"), F.col("location_fit"), F.col("location"),
                                                    F.col("reason"), F.col("url")))
    g = t.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("rank", "ls"))).alias("_e"))
    lines = F.flatten(F.transform(F.col("_e"), lambda e: e["ls"]))
    header = F.concat(F.lit("["), F.col("company"), F.lit("]"))
    return g.select(F.col("company").alias("source"), F.array_join(F.concat(F.array(header), lines), "\n").alias("message"))


@register("deterministic_candidates", ids="F16 F6",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, company FROM v_postings WHERE {MATCH}"))
def deterministic_candidates(spark, sf):
    """The alert path where classification is switched off."""
    return alert_candidates(spark, sf, replace(R.DEFAULT_RULES, classification_enabled=False)).select("doc_id", "company")


_BOARD_SQL = _HEADER_SQL.replace("CASE service", "CASE provider").replace("source", "company")


@register("classified_board_messages", ids="P17 T10",
          sql=lambda: with_views(["v_postings"], f"""SELECT provider AS service, company AS source, {_BOARD_SQL} || chr(10) ||
              string_agg(line, chr(10) ORDER BY rank) AS message FROM (
                SELECT provider, company, rank, CAST(relevance_score AS VARCHAR) || '/100 | ' || company || ' | ' || title || chr(10) ||
                       role_type || ' | ' || seniority || ' | ' || location_fit || ' | ' ||
                       CASE WHEN location = '' THEN 'Unknown location' ELSE location END || chr(10) || 'Why: ' || reason || chr(10) || url AS line
                FROM (SELECT *, row_number() OVER (PARTITION BY provider, company ORDER BY relevance_score DESC, doc_id) AS rank
                      FROM ({_CLS()}) c WHERE relevance_score >= {TH}) r WHERE rank <= {R.ALERT_LIMIT_BOARD}) y
              GROUP BY provider, company"""))
def classified_board_messages(spark, sf):
    c = C.classify(v_postings(spark, sf)).withColumn("_ok", F.col("relevance_score") >= TH).where("_ok")
    return A.classified_messages(c, R.ALERT_LIMIT_BOARD)
