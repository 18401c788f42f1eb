"""Landed poll responses (S1-S3, R12) and their VARIANT-based parsers.

A landed response is one poll of one board:
``(seq, service, source, http_status, error_kind, error_message, etag,
last_modified, fetched_ts, body)``.  Live polling writes these rows; here they
are derived by Spark from ``v_postings`` (one response per provider, board and
``doc_id div 10``; at most 10 postings per body, descriptions whole).  Every
posting is in a whole body; by a fixed rule some boards are polled a second time
half a minute later, with the same body or with a failure, as extra rows, so
every status path is exercised and postings recur.

Bodies are parsed with ``try_parse_json`` into VARIANT: a truncated body
becomes null (an ``exception`` outcome) instead of failing the job, and
polymorphic members (``location`` as object or string) are told apart with
``schema_of_variant``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsignal.sources.testdata import v_postings

RESP_SIZE = 10
FETCH_BASE_TS = 1704067200
# Second poll by (response id % 17): 1 -> the board's task was lost, 3 -> the same body, 5 -> HTTP 500, 7 -> 304 (Greenhouse/Lever),
# 9 -> timeout, 11 -> truncated body, 13 -> GraphQL error (Ashby), 15 -> non-array body (Lever).
GQL_ERROR_BODY = '{"errors":[{"message":"Organization not found"}]}'
NON_ARRAY_BODY = '{"message":"not an array"}'
TRUNCATE_AT = 20
LOST_TASK = "OperationalError"


def _job_json(p: DataFrame) -> Column:
    d = F.col("doc_id")
    gh_common = [
        d.alias("id"), F.col("title").alias("title"),
        F.when(d % 4 != 0, F.col("url")).alias("absolute_url"),
        F.concat(F.lit("u"), d.cast("string")).alias("updated_at"),
    ]
    gh_tail = [
        F.array(F.struct(F.concat(F.lit("Office "), F.col("company")).alias("name"))).alias("offices"),
        F.array(F.struct(F.concat(F.lit("Dept "), (d % 3).cast("string")).alias("name"))).alias("departments"),
        F.concat(F.lit("<p>"), F.col("description"), F.lit("</p>")).alias("content"),
    ]
    gh_obj = F.to_json(F.struct(*gh_common, F.struct(F.col("location").alias("name")).alias("location"), *gh_tail))
    gh_str = F.to_json(F.struct(*gh_common, F.col("location").alias("location"), *gh_tail))
    lever = F.to_json(F.struct(
        F.concat(F.lit("L"), d.cast("string")).alias("id"), F.col("title").alias("text"),
        F.when(d % 4 != 0, F.col("url")).alias("applyUrl"), (d * 1000).alias("updatedAt"),
        F.struct(F.col("location").alias("location"), F.lit("Full-time").alias("commitment"),
                 F.concat(F.lit("Team "), (d % 5).cast("string")).alias("team")).alias("categories"),
        F.when(d % 5 == 0, F.lit("remote")).when(d % 5 == 1, F.lit("hybrid")).alias("workplaceType"),
        F.col("description").alias("descriptionPlain"),
        F.array(F.struct(F.lit("Requirements").alias("text"),
                         F.concat(F.lit("<li>"), F.col("title"), F.lit("</li>")).alias("content"))).alias("lists"),
    ))
    ashby = F.to_json(F.struct(
        F.concat(F.lit("A"), d.cast("string")).alias("id"), F.col("title").alias("title"),
        F.col("location").alias("locationName"),
        F.when(d % 4 == 0, F.lit("Remote")).when(d % 4 == 1, F.lit("OnSite")).alias("workplaceType"),
        F.lit("FullTime").alias("employmentType"), F.col("description").alias("descriptionPlain"),
    ))
    return (F.when(F.col("provider") == "greenhouse", F.when(d % 2 == 0, gh_obj).otherwise(gh_str))
            .when(F.col("provider") == "lever", lever).otherwise(ashby))


def landed_responses(spark, sf_dir: str) -> DataFrame:
    """Landed responses derived from the postings (bounded body per response)."""
    p = v_postings(spark, sf_dir).withColumn("resp_id", F.expr("doc_id div 10"))
    g = p.groupBy("provider", "company", "resp_id").agg(
        F.min("doc_id").alias("seq"),
        F.sort_array(F.collect_list(F.struct("doc_id", _job_json(p).alias("j")))).alias("_items"),
    )
    items = F.array_join(F.transform(F.col("_items"), lambda x: x["j"]), ",")
    svc, r = F.col("provider"), F.col("resp_id") % 17
    body = (F.when(svc == "greenhouse", F.concat(F.lit('{"jobs":['), items, F.lit("]}")))
            .when(svc == "lever", F.concat(F.lit("["), items, F.lit("]")))
            .otherwise(F.concat(F.lit('{"data":{"jobBoardWithTeams":{"jobPostings":['), items, F.lit("]}}}"))))
    extra = (F.when(r == 1, F.lit("task")).when(r == 3, F.lit("again")).when(r == 5, F.lit("http")).when((r == 7) & (svc != "ashby"), F.lit("304"))
             .when(r == 9, F.lit("timeout")).when(r == 11, F.lit("cut")).when((r == 13) & (svc == "ashby"), F.lit("gql"))
             .when((r == 15) & (svc == "lever"), F.lit("shape")))
    g = g.select("provider", "company", "resp_id", "seq", body.alias("full"), F.explode(F.array_compact(F.array(F.lit("whole"), extra))).alias("kind"))
    kind, second = F.col("kind"), (F.col("kind") != "whole").cast("long")
    body = (F.when(kind.isin("whole", "again"), F.col("full")).when(kind == "cut", F.substring("full", 1, TRUNCATE_AT))
            .when(kind == "gql", F.lit(GQL_ERROR_BODY)).when(kind == "shape", F.lit(NON_ARRAY_BODY)))
    status = F.when(kind == "http", F.lit(500)).when(kind == "304", F.lit(304)).when(~kind.isin("timeout", "task"), F.lit(200))
    seq = 2 * F.col("seq") + second
    return g.select(
        seq.alias("seq"), svc.alias("service"), F.col("company").alias("source"), status.alias("http_status"),
        F.when(kind.isin("timeout", "task"), kind).alias("error_kind"), F.when(kind == "task", F.lit(LOST_TASK)).alias("error_message"),
        F.when(status == 200, F.concat(F.lit('W/"'), seq.cast("string"), F.lit('"'))).alias("etag"),
        F.when(status == 200, F.concat(F.lit("modified "), seq.cast("string"))).alias("last_modified"),
        (F.lit(FETCH_BASE_TS) + F.col("resp_id") * 60 + 30 * second).alias("fetched_ts"), body.alias("body"),
    )


def read_landed(spark, path: str) -> DataFrame:
    """Landed responses written by a poller (parquet or JSON lines)."""
    return spark.read.parquet(path) if not path.endswith(".json") else spark.read.json(path)


# --- parsing -----------------------------------------------------------------------


def parsed(resp: DataFrame) -> DataFrame:
    """Adds ``v`` (VARIANT body, null when missing or malformed)."""
    return resp.withColumn("v", F.try_parse_json(F.col("body")))


def postings_array(service: Column, v: Column) -> Column:
    """Provider posting array; any missing level or non-array -> empty."""
    empty = F.array().cast("array<variant>")
    arr = (F.when(service == "ashby", F.try_variant_get(v, "$.data.jobBoardWithTeams.jobPostings", "array<variant>"))
           .when(service == "greenhouse", F.try_variant_get(v, "$.jobs", "array<variant>"))
           .otherwise(F.try_variant_get(v, "$", "array<variant>")))
    return F.coalesce(arr, empty)


def explode_postings(resp: DataFrame) -> DataFrame:
    """One row per posting: (seq, service, source, fetched_ts, pos, p) for OK responses."""
    ok = parsed(resp).where((F.col("http_status") == 200) & F.col("v").isNotNull())
    ok = ok.where(~((F.col("service") == "ashby") & gql_error(F.col("v")).isNotNull()))
    return ok.select("seq", "service", "source", "fetched_ts",
                     F.posexplode(postings_array(F.col("service"), F.col("v"))).alias("pos", "p")).withColumn("pos", F.col("pos").cast("long"))


def gql_error(v: Column) -> Column:
    """Ashby GraphQL error message ('graphql_error' when the message is empty)."""
    errs = F.try_variant_get(v, "$.errors", "array<variant>")
    msg = F.try_variant_get(v, "$.errors[0].message", "string")
    return F.when(F.size(F.coalesce(errs, F.array().cast("array<variant>"))) > 0,
                  F.coalesce(F.nullif(F.trim(msg), F.lit("")), F.lit("graphql_error")))


def vstr(p: Column, path: str) -> Column:
    """String member (numbers rendered as text), null when absent."""
    return F.try_variant_get(p, path, "string")


def name_or_string(x: Column) -> Column:
    """An object's ``name`` or a bare string (the polymorphic location shape)."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(
        F.try_variant_get(x, "$.name", "string"))


def variant_list(p: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(p, path, "array<variant>"), F.array().cast("array<variant>"))
