"""Provider normalisers and poll outcomes.

Every function is a projection over exploded VARIANT postings or over
landed responses — no shuffle except the per-board state roll-ups (J6, R11),
which aggregate or window on ``(service, source)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.sources import landed as L

ASHBY_GQL_ENDPOINT = "https://jobs.ashbyhq.com/api/non-user-graphql?op=ApiJobBoardWithTeams"
INVALID_BODY = "invalid JSON body"
TASK_LOST = "task_exception:"


def _s(c: Column) -> Column:
    return X.strip_ws(F.coalesce(c, F.lit("")))


def greenhouse_location(p: Column) -> Column:
    """P5: location, then locations, additional_locations and offices; distinct, ', '."""
    items = F.concat(
        F.array(L.name_or_string(F.try_variant_get(p, "$.location", "variant"))),
        *[F.transform(L.variant_list(p, f"$.{k}"), L.name_or_string) for k in ("locations", "additional_locations", "offices")],
    )
    return X.join_text(items, ", ")


def lever_location(p: Column) -> Column:
    """Categories.location/commitment/team/department, location, workplaceType."""
    items = F.array(
        *[L.vstr(p, f"$.categories.{k}") for k in ("location", "commitment", "team", "department")],
        L.name_or_string(F.try_variant_get(p, "$.location", "variant")),
        L.vstr(p, "$.workplaceType"),
    )
    return X.join_text(items, ", ")


def department_text(p: Column) -> Column:
    """P7."""
    return X.join_text(F.transform(L.variant_list(p, "$.departments"), lambda x: F.try_variant_get(x, "$.name", "string")), ", ")


def lever_lists_text(p: Column) -> Column:
    """Heading and stripped content of each list item, flattened."""
    parts = F.transform(L.variant_list(p, "$.lists"), lambda x: F.array(
        X.compact_text(F.try_variant_get(x, "$.text", "string")), X.strip_html(F.try_variant_get(x, "$.content", "string"))))
    return X.join_text(F.flatten(parts))


def greenhouse_location_texts(p: Column) -> Column:
    """Location object name (a bare string is ignored), locations, additional_locations."""
    loc = F.try_variant_get(p, "$.location", "variant")
    first = F.when(F.schema_of_variant(loc).startswith("OBJECT"), F.try_variant_get(loc, "$.name", "string"))
    items = F.concat(F.array(first), *[F.transform(L.variant_list(p, f"$.{k}"), L.name_or_string)
                                       for k in ("locations", "additional_locations")])
    return F.filter(F.transform(items, lambda t: X.strip_ws(t)), lambda t: F.coalesce(t, F.lit("")) != "")


def lever_location_texts(p: Column) -> Column:
    """P10: categories.location, location, workplaceType, top-level team and department."""
    items = F.array(L.vstr(p, "$.categories.location"), L.name_or_string(F.try_variant_get(p, "$.location", "variant")),
                    L.vstr(p, "$.workplaceType"), L.vstr(p, "$.team"), L.vstr(p, "$.department"))
    return F.filter(F.transform(items, lambda t: X.strip_ws(t)), lambda t: F.coalesce(t, F.lit("")) != "")


def normalize(postings: DataFrame) -> DataFrame:
    """One 8-column job shape for all providers (plus seq/pos/fetched_ts lineage)."""
    p, svc, co = F.col("p"), F.col("service"), F.col("source")
    job_id = _s(L.vstr(p, "$.id"))
    ashby_url = F.when(job_id != "", F.concat(F.lit(f"https://{R.HOSTS['ashby']}/"), co, F.lit("/"), job_id)).otherwise(
        F.concat(F.lit(f"https://{R.HOSTS['ashby']}/"), co))
    gh_url = F.coalesce(F.nullif(_s(L.vstr(p, "$.absolute_url")), F.lit("")), F.when(
        job_id != "", F.concat(F.lit(f"https://{R.HOSTS['greenhouse']}/"), co, F.lit("/jobs/"), job_id)), F.lit(""))
    lever_url = F.coalesce(F.nullif(_s(L.vstr(p, "$.applyUrl")), F.lit("")), F.when(
        job_id != "", F.concat(F.lit(f"https://{R.HOSTS['lever']}/"), co, F.lit("/"), job_id)).otherwise(
        F.concat(F.lit(f"https://{R.HOSTS['lever']}/"), co)))
    ashby_desc = X.join_text(F.array(
        L.vstr(p, "$.descriptionPlain"),
        X.strip_html(F.coalesce(F.nullif(L.vstr(p, "$.descriptionHtml"), F.lit("")), L.vstr(p, "$.description"))),
        L.vstr(p, "$.employmentType")))
    gh_desc = X.join_text(F.array(X.strip_html(L.vstr(p, "$.content")), X.strip_html(L.vstr(p, "$.description")), department_text(p)))
    lever_desc = X.join_text(F.array(
        L.vstr(p, "$.descriptionPlain"), X.strip_html(L.vstr(p, "$.description")), L.vstr(p, "$.additionalPlain"),
        X.strip_html(L.vstr(p, "$.additional")), lever_lists_text(p)))

    def by(a, g, lv):
        return F.when(svc == "ashby", a).when(svc == "greenhouse", g).otherwise(lv)

    return postings.select(
        "seq", "pos", "fetched_ts", svc.alias("provider"), co.alias("company"), job_id.alias("external_job_id"),
        by(_s(L.vstr(p, "$.title")), _s(L.vstr(p, "$.title")), _s(L.vstr(p, "$.text"))).alias("title"),
        by(_s(L.vstr(p, "$.locationName")), greenhouse_location(p), lever_location(p)).alias("location"),
        by(ashby_url, gh_url, lever_url).alias("url"),
        by(ashby_desc, gh_desc, lever_desc).alias("description"),
        F.to_json(p).alias("raw"),
    )


def fingerprint(service: Column, v: Column) -> Column:
    """SHA-256 of [{id, updated_at|updatedAt}] in response order, nulls kept."""
    arr = L.postings_array(service, v)
    ts_key = F.when(service == "lever", F.lit("updatedAt")).otherwise(F.lit("updated_at"))
    gh = F.to_json(F.transform(arr, lambda e: F.struct(F.try_variant_get(e, "$.id", "variant").alias("id"),
                                                       F.try_variant_get(e, "$.updated_at", "variant").alias("updated_at"))),
                   {"ignoreNullFields": "false"})
    lv = F.to_json(F.transform(arr, lambda e: F.struct(F.try_variant_get(e, "$.id", "variant").alias("id"),
                                                       F.try_variant_get(e, "$.updatedAt", "variant").alias("updatedAt"))),
                   {"ignoreNullFields": "false"})
    return F.sha2(F.when(ts_key == "updatedAt", lv).otherwise(gh), 256)


def poll_status(resp: DataFrame) -> DataFrame:
    """Outcome string of each landed response (before 'new match')."""
    r = L.parsed(resp)
    svc, code, kind = F.col("service"), F.col("http_status"), F.col("error_kind")
    msg = F.coalesce(F.col("error_message"), F.lit(INVALID_BODY))
    ashby = (F.when(kind == "timeout", F.lit("timeout"))
             .when(kind.isNotNull(), F.concat(F.lit("exception:"), msg))
             .when(code != 200, F.concat(F.lit("http_"), code.cast("string")))
             .when(F.col("v").isNull(), F.concat(F.lit("exception:"), msg))
             .when(L.gql_error(F.col("v")).isNotNull(), F.concat(F.lit("gql_error:"), L.gql_error(F.col("v"))))
             .otherwise(F.lit("ok")))
    board = (F.when(kind == "timeout", F.lit("timeout"))
             .when(kind.isNotNull(), F.concat(F.lit("exception: "), msg))
             .when(code == 304, F.lit("unchanged (304)"))
             .when(code != 200, F.concat(F.lit("error HTTP "), code.cast("string")))
             .when(F.col("v").isNull(), F.concat(F.lit("exception: "), msg))
             .otherwise(F.lit("ok")))
    lost = F.when(kind == "task", F.concat(F.lit(TASK_LOST), msg))
    return r.select("seq", "service", "source", "fetched_ts", "http_status",
                    F.coalesce(lost, F.when(svc == "ashby", ashby).otherwise(board)).alias("status"),
                    F.when(F.col("v").isNotNull(), fingerprint(svc, F.col("v"))).alias("fingerprint"), "etag", "last_modified")


def board_parts(status: DataFrame) -> DataFrame:
    """J6 of the responses of these outcomes (:func:`poll_status`): ``_s`` is the poll state of the last successful one (null without one).

    A lost task (R12) has saved nothing, so it moves nothing."""
    s = status.where(~F.col("status").startswith(TASK_LOST))
    ok = F.col("status") == "ok"
    return s.groupBy("service", "source").agg(
        F.max_by(F.struct("etag", "last_modified", "fingerprint"), F.when(ok, F.col("seq"))).alias("_s"),
        F.max("fetched_ts").alias("last_seen_ts"))


def board_columns(parts: DataFrame) -> DataFrame:
    return parts.select("service", "source", F.col("_s.etag").alias("etag"), F.col("_s.last_modified").alias("last_modified"),
                        F.col("_s.fingerprint").alias("fingerprint"), "last_seen_ts")


def board_state(resp: DataFrame) -> DataFrame:
    """Per board, the last successful response sets etag/last_modified/fingerprint
    (null included); any outcome moves last_seen_ts."""
    return board_columns(board_parts(poll_status(resp)))


def skip_unchanged(resp: DataFrame) -> DataFrame:
    """Responses that need no processing: 304 only.  The fingerprint is board state;
    equal fingerprints are processed like any other response."""
    return poll_status(resp).withColumn("skip", F.coalesce(F.col("http_status") == 304, F.lit(False)))


def board_result(resp: DataFrame) -> DataFrame:
    """Outcome, counts and detail of each response, net of ids already notified.

    A match counts as new in the first response of its board that holds it; later
    responses with the same posting are 'ok'.  One aggregate per (board, id) and one
    per response."""
    posts = L.explode_postings(resp)
    counts = posts.groupBy("seq").agg(F.count(F.lit(1)).alias("postings"))
    first = posting_matches(posts).groupBy("service", "source", "external_job_id").agg(F.min("seq").alias("seq"))
    new = first.groupBy("seq").agg(F.count(F.lit(1)).alias("new_matches"))
    return outcomes(poll_status(resp), counts, new)


def outcomes(status: DataFrame, counts: DataFrame, new: DataFrame) -> DataFrame:
    """A19 from each response's status, its number of postings and of new matches."""
    j = status.join(counts, "seq", "left").join(new, "seq", "left")
    n, nm, ok = F.coalesce("postings", F.lit(0)), F.coalesce("new_matches", F.lit(0)), F.col("status") == "ok"
    word = F.when(F.col("service") == "ashby", F.lit("postings=")).otherwise(F.lit("jobs="))
    return j.select("seq", "service", "source", "fetched_ts", F.when(ok & (nm > 0), F.lit("new match")).otherwise(F.col("status")).alias("status"),
                    n.alias("postings"), nm.alias("new_matches"),
                    F.when(ok, F.concat(word, n.cast("string"), F.lit(" new_matches="), nm.cast("string"))).alias("detail"))


def api_url(service: Column, source: Column) -> Column:
    """Provider API endpoint of a board."""
    return (F.when(service == "greenhouse", F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), source, F.lit("/jobs")))
            .when(service == "lever", F.concat(F.lit("https://api.lever.co/v0/postings/"), source, F.lit("?mode=json")))
            .otherwise(F.lit(ASHBY_GQL_ENDPOINT)))


def poll_plan(boards: DataFrame, state: DataFrame) -> DataFrame:
    """Request table — URL and conditional headers from the saved state (no HTTP here)."""
    j = boards.join(state, ["service", "source"], "left")
    return j.select("service", "source", api_url(F.col("service"), F.col("source")).alias("url"),
                    F.when(F.col("service") != "ashby", F.col("etag")).alias("if_none_match"),
                    F.when(F.col("service") != "ashby", F.col("last_modified")).alias("if_modified_since"))


def posting_matches(postings: DataFrame) -> DataFrame:
    """F4/F6 on parsed postings: W7 dedupe (Greenhouse, Lever), title rule, US location."""
    p, svc = F.col("p"), F.col("service")
    ids = _s(L.vstr(p, "$.id"))
    title = F.when(svc == "lever", L.vstr(p, "$.text")).otherwise(L.vstr(p, "$.title"))
    texts = F.when(svc == "greenhouse", greenhouse_location_texts(p)).otherwise(lever_location_texts(p))
    us = F.when(svc == "ashby", P.is_us_location(_s(L.vstr(p, "$.locationName")))).otherwise(P.any_us_location(texts))
    x = postings.select("seq", "pos", "service", "source", "fetched_ts", ids.alias("external_job_id"), _s(title).alias("title"), us.alias("is_us"),
                        _s(L.vstr(p, "$.applyUrl")).alias("apply_url"), F.try_variant_get(p, "$.updatedAt", "long").alias("updated_ms"))
    w = Window.partitionBy("seq", "external_job_id").orderBy(F.desc("pos"))
    x = x.withColumn("_rn", F.row_number().over(w))
    keep = (svc == "ashby") | ((F.col("_rn") == 1) & P.nonempty_id(F.col("external_job_id")))
    return x.where(keep & P.title_matches(F.col("title")) & P.nonempty_id(F.col("external_job_id")) & F.col("is_us")).drop("_rn")
