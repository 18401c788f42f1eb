"""Queries over landed poll responses: parse, normalise, status, board state."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.functions.text import q
from jobsignal.operators import normalize as N
from jobsignal.plans.registry import register
from jobsignal.sources import landed as L
from jobsignal.sources.testdata import v_html, with_views

S = X.sql
PP = "SELECT *, doc_id // 10 AS resp_id, (doc_id // 10) % 17 AS r FROM v_postings"
KIND = ("CASE WHEN r = 1 THEN 'task' WHEN r = 3 THEN 'again' WHEN r = 5 THEN 'http' WHEN r = 7 AND provider <> 'ashby' THEN '304' WHEN r = 9 THEN 'timeout' WHEN r = 11 THEN 'cut' "
        "WHEN r = 13 AND provider = 'ashby' THEN 'gql' WHEN r = 15 AND provider = 'lever' THEN 'shape' END")
# one row per response: every board's whole body, and the second polls
RESP = (f"SELECT provider, company, resp_id, 2 * min(doc_id) AS seq, count(*) AS n, 'whole' AS kind, {L.FETCH_BASE_TS} + resp_id * 60 AS ts FROM pp GROUP BY ALL "
        f"UNION ALL SELECT provider, company, resp_id, 2 * min(doc_id) + 1, count(*), {KIND}, {L.FETCH_BASE_TS} + resp_id * 60 + 30 "
        f"FROM pp WHERE {KIND} IS NOT NULL GROUP BY provider, company, resp_id, r")
OKP = ("SELECT pp.*, resp.seq, resp.ts, row_number() OVER (PARTITION BY resp.seq ORDER BY doc_id) - 1 AS pos "
       "FROM pp JOIN resp USING (provider, company, resp_id) WHERE resp.kind IN ('whole', 'again')")
STATUS = (f"CASE WHEN kind = 'task' THEN 'task_exception:{L.LOST_TASK}' WHEN kind = 'timeout' THEN 'timeout' WHEN kind IN ('whole', 'again', 'shape') THEN 'ok' "
          "WHEN provider = 'ashby' THEN CASE kind WHEN 'http' THEN 'http_500' WHEN 'cut' THEN 'exception:invalid JSON body' ELSE 'gql_error:Organization not found' END "
          "ELSE CASE kind WHEN '304' THEN 'unchanged (304)' WHEN 'http' THEN 'error HTTP 500' ELSE 'exception: invalid JSON body' END END")
EXT_ID = "CASE provider WHEN 'ashby' THEN 'A' || CAST(doc_id AS VARCHAR) WHEN 'lever' THEN 'L' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END"
WT = "CASE WHEN doc_id % 5 = 0 THEN 'remote' WHEN doc_id % 5 = 1 THEN 'hybrid' END"


def psql(body: str, okp: bool = True) -> str:
    ctes = [("pp", PP), ("resp", RESP)] + ([("okp", OKP)] if okp else [])
    return with_views(["v_postings"], body, ctes)


def _norm_sql() -> str:
    loc_gh = S.join_text(f"[location, 'Office ' || company]", ", ")
    url_gh = f"CASE WHEN doc_id % 4 <> 0 THEN {S.strip_ws('url')} ELSE 'https://boards.greenhouse.io/' || company || '/jobs/' || CAST(doc_id AS VARCHAR) END"
    desc_gh = S.join_text(f"[{S.strip_html(chr(39) + '<p>' + chr(39) + ' || description || ' + chr(39) + '</p>' + chr(39))}, '', "
                          f"{S.join_text('[' + chr(39) + 'Dept ' + chr(39) + ' || CAST(doc_id % 3 AS VARCHAR)]', ', ')}]")
    loc_lv = S.join_text(f"[location, 'Full-time', 'Team ' || CAST(doc_id % 5 AS VARCHAR), {WT}]", ", ")
    url_lv = f"CASE WHEN doc_id % 4 <> 0 THEN {S.strip_ws('url')} ELSE 'https://jobs.lever.co/' || company || '/L' || CAST(doc_id AS VARCHAR) END"
    lists = S.join_text(f"['Requirements', {S.strip_html(chr(39) + '<li>' + chr(39) + ' || title || ' + chr(39) + '</li>' + chr(39))}]")
    desc_lv = S.join_text(f"[description, '', NULL, '', {lists}]")
    desc_ab = S.join_text("[description, '', 'FullTime']")
    return (f"SELECT seq, pos, provider, company, {EXT_ID} AS external_job_id, {S.strip_ws('title')} AS title, "
            f"CASE provider WHEN 'ashby' THEN {S.strip_ws('location')} WHEN 'greenhouse' THEN {loc_gh} ELSE {loc_lv} END AS location, "
            f"CASE provider WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || company || '/A' || CAST(doc_id AS VARCHAR) "
            f"WHEN 'greenhouse' THEN {url_gh} ELSE {url_lv} END AS url, "
            f"CASE provider WHEN 'ashby' THEN {desc_ab} WHEN 'greenhouse' THEN {desc_gh} ELSE {desc_lv} END AS description FROM okp")


def _landed(spark, sf):
    return L.landed_responses(spark, sf)


def _postings(spark, sf):
    return L.explode_postings(_landed(spark, sf))


def _norm(spark, sf):
    return N.normalize(_postings(spark, sf)).drop("raw", "fetched_ts")


@register("raw_responses", ids="S1-S3 (landed table)")
def raw_responses(spark, sf):
    return _landed(spark, sf)


@register("poll_status", ids="P13 R12",
          sql=lambda: psql(f"SELECT seq, provider AS service, company AS source, {STATUS} AS status FROM resp", okp=False))
def poll_status(spark, sf):
    return N.poll_status(_landed(spark, sf)).select("seq", "service", "source", "status")


@register("response_cycle_counts", ids="A7 R12", sql=lambda: psql(f"""SELECT service, ts - ts % 3600 AS cycle_ts, status, count(*) AS boards
    FROM (SELECT provider AS service, ts, {STATUS} AS status FROM resp) s GROUP BY ALL""", okp=False))
def response_cycle_counts(spark, sf):
    """Boards per outcome of each hour's polls, lost tasks included."""
    s = N.poll_status(_landed(spark, sf))
    return s.groupBy("service", (F.col("fetched_ts") - F.col("fetched_ts") % 3600).alias("cycle_ts"), "status").agg(F.count(F.lit(1)).alias("boards"))


def _src(service: str):
    def build(spark, sf):
        return _postings(spark, sf).where(F.col("service") == service).select(
            "seq", "service", "source", "pos", L.vstr(F.col("p"), "$.id").alias("id"))
    return build


for _name, _svc, _ids in (("src_ashby_postings", "ashby", "S1"), ("src_greenhouse_jobs", "greenhouse", "S2"),
                          ("src_lever_postings", "lever", "S3")):
    register(_name, ids=_ids, sql=(lambda s=_svc: psql(
        f"SELECT seq, provider AS service, company AS source, pos, {EXT_ID} AS id FROM okp WHERE provider = '{s}'")))(_src(_svc))


def _norm_q(service: str | None):
    def build(spark, sf):
        n = _norm(spark, sf)
        return n if service is None else n.where(F.col("provider") == service)
    return build


for _name, _svc, _ids in (("norm_ashby", "ashby", "P1"), ("norm_greenhouse", "greenhouse", "P2 P5 P7 X1 X3"),
                          ("norm_lever", "lever", "P3 P6 P8"), ("norm_all", None, "P4 U1")):
    register(_name, ids=_ids, sql=(lambda s=_svc: psql(
        f"SELECT * FROM ({_norm_sql()}) n" + (f" WHERE provider = '{s}'" if s else ""))))(_norm_q(_svc))


@register("loc_texts_greenhouse", ids="P9",
          sql=lambda: psql(f"SELECT seq, pos, CASE WHEN doc_id % 2 = 0 AND {S.strip_ws('location')} <> '' THEN {S.strip_ws('location')} ELSE '' END AS texts FROM okp WHERE provider = 'greenhouse'"))
def loc_texts_greenhouse(spark, sf):
    p = _postings(spark, sf).where(F.col("service") == "greenhouse")
    return p.select("seq", "pos", F.array_join(N.greenhouse_location_texts(F.col("p")), "|").alias("texts"))


@register("loc_texts_lever", ids="P10",
          sql=lambda: psql(f"SELECT seq, pos, array_to_string(list_filter([{S.strip_ws('location')}, {WT}], lambda t: coalesce(t, '') <> ''), '|') AS texts FROM okp WHERE provider = 'lever'"))
def loc_texts_lever(spark, sf):
    p = _postings(spark, sf).where(F.col("service") == "lever")
    return p.select("seq", "pos", F.array_join(N.lever_location_texts(F.col("p")), "|").alias("texts"))


@register("any_us_location", ids="F4",
          sql=lambda: psql(f"""SELECT seq, pos, CASE provider WHEN 'greenhouse' THEN doc_id % 2 = 0 AND {P.sql.is_us_location(S.strip_ws('location'))}
              ELSE {P.sql.is_us_location(S.strip_ws('location'))} OR coalesce({P.sql.is_us_location(WT)} AND ({WT}) IS NOT NULL, false) END AS is_us
              FROM okp WHERE provider <> 'ashby'"""))
def any_us_location(spark, sf):
    p = _postings(spark, sf).where(F.col("service") != "ashby")
    texts = F.when(F.col("service") == "greenhouse", N.greenhouse_location_texts(F.col("p"))).otherwise(N.lever_location_texts(F.col("p")))
    return p.select("seq", "pos", P.any_us_location(texts).alias("is_us"))


@register("posting_matches", ids="F6 F4 W7 (parsed)",
          sql=lambda: psql(f"""SELECT seq, provider AS service, company AS source, {EXT_ID} AS external_job_id FROM okp
              WHERE {P.sql.title_matches(S.strip_ws('title'))} AND CASE provider
                WHEN 'ashby' THEN {P.sql.is_us_location(S.strip_ws('location'))}
                WHEN 'greenhouse' THEN doc_id % 2 = 0 AND {P.sql.is_us_location(S.strip_ws('location'))}
                ELSE {P.sql.is_us_location(S.strip_ws('location'))} OR coalesce({P.sql.is_us_location(WT)} AND ({WT}) IS NOT NULL, false) END"""))
def posting_matches(spark, sf):
    return N.posting_matches(_postings(spark, sf)).select("seq", "service", "source", "external_job_id")


def _fp_sql() -> str:
    item = ("CASE provider WHEN 'greenhouse' THEN '{\"id\":' || CAST(doc_id AS VARCHAR) || ',\"updated_at\":\"u' || CAST(doc_id AS VARCHAR) || '\"}' "
            "ELSE '{\"id\":\"L' || CAST(doc_id AS VARCHAR) || '\",\"updatedAt\":' || CAST(doc_id * 1000 AS VARCHAR) || '}' END")
    return psql(f"""SELECT resp.seq, provider AS service, company AS source,
        sha256(CASE WHEN kind = 'shape' THEN '[]' ELSE '[' || string_agg({item}, ',' ORDER BY doc_id) || ']' END) AS fingerprint
        FROM pp JOIN resp USING (provider, company, resp_id) WHERE provider <> 'ashby' AND kind IN ('whole', 'again', 'shape')
        GROUP BY provider, company, resp.seq, kind""", okp=False)


@register("board_fingerprint", ids="X8", sql=_fp_sql)
def board_fingerprint(spark, sf):
    s = N.poll_status(_landed(spark, sf))
    return s.where((F.col("status") == "ok") & (F.col("service") != "ashby")).select("seq", "service", "source", "fingerprint")


_STATE_SQL = """SELECT provider AS service, company AS source, max(CASE WHEN kind IN ('whole', 'again', 'shape') THEN seq END) AS ok_seq, max(CASE WHEN kind <> 'task' THEN ts END) AS last_ts
    FROM resp GROUP BY provider, company"""


@register("board_state_update", ids="J6 S13",
          sql=lambda: psql(f"""SELECT service, source, 'W/"' || CAST(ok_seq AS VARCHAR) || '"' AS etag, 'modified ' || CAST(ok_seq AS VARCHAR) AS last_modified,
              last_ts AS last_seen_ts FROM ({_STATE_SQL}) s""", okp=False))
def board_state_update(spark, sf):
    return N.board_state(_landed(spark, sf)).select("service", "source", "etag", "last_modified", "last_seen_ts")


@register("skip_unchanged", ids="R11",
          sql=lambda: psql("SELECT seq, provider AS service, company AS source, kind = '304' AS skip FROM resp", okp=False))
def skip_unchanged(spark, sf):
    return N.skip_unchanged(_landed(spark, sf)).select("seq", "service", "source", "skip")


@register("poll_plan", ids="P14 X24",
          sql=lambda: psql(f"""SELECT service, source,
              CASE service WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || source || '/jobs'
                           WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || source || '?mode=json'
                           ELSE {q(N.ASHBY_GQL_ENDPOINT)} END AS url,
              CASE WHEN service <> 'ashby' THEN 'W/"' || CAST(ok_seq AS VARCHAR) || '"' END AS if_none_match,
              CASE WHEN service <> 'ashby' THEN 'modified ' || CAST(ok_seq AS VARCHAR) END AS if_modified_since FROM ({_STATE_SQL}) s""", okp=False))
def poll_plan(spark, sf):
    landed = _landed(spark, sf)
    boards = landed.select("service", "source").distinct()
    return N.poll_plan(boards, N.board_state(landed))


_MATCH_SQL = f"""{P.sql.title_matches(S.strip_ws('title'))} AND CASE provider
    WHEN 'ashby' THEN {P.sql.is_us_location(S.strip_ws('location'))}
    WHEN 'greenhouse' THEN doc_id % 2 = 0 AND {P.sql.is_us_location(S.strip_ws('location'))}
    ELSE {P.sql.is_us_location(S.strip_ws('location'))} OR coalesce({P.sql.is_us_location(WT)} AND ({WT}) IS NOT NULL, false) END"""
BOARD_RESULT_SQL = f"""SELECT g.seq, g.service, g.source, g.ts, CASE WHEN g.status = 'ok' AND coalesce(m.n, 0) > 0 THEN 'new match' ELSE g.status END AS status,
    g.postings, coalesce(m.n, 0) AS new_matches, CASE WHEN g.status = 'ok' THEN CASE g.service WHEN 'ashby' THEN 'postings=' ELSE 'jobs=' END
      || CAST(g.postings AS VARCHAR) || ' new_matches=' || CAST(coalesce(m.n, 0) AS VARCHAR) END AS detail
    FROM (SELECT seq, provider AS service, company AS source, ts, {STATUS} AS status, CASE WHEN kind IN ('whole', 'again') THEN n ELSE 0 END AS postings FROM resp) g
    LEFT JOIN (SELECT seq, count(*) AS n FROM (SELECT doc_id, min(seq) AS seq FROM okp WHERE {_MATCH_SQL} GROUP BY doc_id) f GROUP BY seq) m ON m.seq = g.seq"""


def _board_result(spark, sf):
    return N.board_result(_landed(spark, sf))


@register("board_result", ids="A19 P13", sql=lambda: psql(f"SELECT * EXCLUDE (ts) FROM ({BOARD_RESULT_SQL}) b"))
def board_result(spark, sf):
    return _board_result(spark, sf).drop("fetched_ts")


@register("strip_html", ids="X1", sql=lambda: with_views(["v_html"], f"SELECT page_id, {S.strip_html('html')} AS text FROM v_html"))
def strip_html(spark, sf):
    return v_html(spark, sf).select("page_id", X.strip_html(F.col("html")).alias("text"))


@register("join_text", ids="X3",
          sql=lambda: with_views(["v_html"], "SELECT page_id, " + S.join_text("string_split(html, '<')", " | ") + " AS joined FROM v_html"))
def join_text(spark, sf):
    return v_html(spark, sf).select("page_id", X.join_text(F.split(F.col("html"), "<", -1), " | ").alias("joined"))


# --- X20: landed postings in canonical form ---------------------------------------------------


def _members(*members: tuple[str, str]) -> str:
    """JSON object of (key, rendered value or NULL), keys given in order."""
    return "'{' || concat_ws(', ', " + ", ".join(f"""'"{k}": ' || {v}""" for k, v in members) + ") || '}'"


def _canonical_sql() -> str:
    js, num = X.sql.json_string, "CAST(doc_id{} AS VARCHAR)".format
    link = f"CASE WHEN doc_id % 4 <> 0 THEN {js('url')} END"
    place = _members(("name", js("location")))
    dept = "'[' || " + _members(("name", js("('Dept ' || CAST(doc_id % 3 AS VARCHAR))"))) + " || ']'"
    office = "'[' || " + _members(("name", js("('Office ' || company)"))) + " || ']'"
    greenhouse = _members(("absolute_url", link), ("content", js("('<p>' || description || '</p>')")),
                          ("departments", dept), ("id", num("")),
                          ("location", f"CASE WHEN doc_id % 2 = 0 THEN {place} ELSE {js('location')} END"),
                          ("offices", office),
                          ("title", js("title")), ("updated_at", js("('u' || CAST(doc_id AS VARCHAR))")))
    lever = _members(("applyUrl", link),
                     ("categories", _members(("commitment", js("'Full-time'")), ("location", js("location")), ("team", js("('Team ' || CAST(doc_id % 5 AS VARCHAR))")))),
                     ("descriptionPlain", js("description")), ("id", js("('L' || CAST(doc_id AS VARCHAR))")),
                     ("lists", "'[' || " + _members(("content", js("('<li>' || title || '</li>')")), ("text", js("'Requirements'"))) + " || ']'"),
                     ("text", js("title")), ("updatedAt", num(" * 1000")), ("workplaceType", js(f"({WT})")))
    ashby = _members(("descriptionPlain", js("description")), ("employmentType", js("'FullTime'")), ("id", js("('A' || CAST(doc_id AS VARCHAR))")),
                     ("locationName", js("location")), ("title", js("title")),
                     ("workplaceType", js("(CASE doc_id % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'OnSite' END)")))
    return (f"SELECT seq, pos, provider AS service, company AS source, CASE provider WHEN 'greenhouse' THEN {greenhouse} "
            f"WHEN 'lever' THEN {lever} ELSE {ashby} END AS raw_json FROM okp")


@register("canonical_json", ids="X20", sql=lambda: psql(_canonical_sql()))
def canonical_json(spark, sf):
    """Every landed posting as it is stored: whole member, sorted keys, plain ASCII."""
    return L.explode_postings(L.landed_responses(spark, sf)).select(
        "seq", "pos", "service", "source", X.canonical_json(F.to_json("p")).alias("raw_json"))
