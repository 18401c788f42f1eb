"""Queries over the job store: change feed, upsert, classifications, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import text as X
from jobsignal.operators import classify as C
from jobsignal.operators import reports as REP
from jobsignal.operators import store as S
from jobsignal.plans.registry import register
from jobsignal.session import state_root
from jobsignal.sources.testdata import v_versions, with_views

# Versions observed before this instant form the existing state; later ones are the batch.
CUTOFF_TS = 883612800  # 1998-01-01T00:00:00Z
MODEL = R.DEFAULT_MODEL
RAW_RESPONSE = '{"engine": "' + MODEL + '", "source": "local_classifier"}'
T = R.LAST_SEEN_INTERVAL_SECONDS
K = "provider, external_job_id"


def versions(spark, sf):
    v = v_versions(spark, sf)
    return v.withColumn("raw_json", F.to_json(F.struct("seq")))


def _jobs(spark, sf):
    return S.upsert(versions(spark, sf))


def _classifications(spark, sf):
    return S.classify_versions(versions(spark, sf))


def _saved(df):
    """A table that several parts of a report read: computed once, in the folder that driver and executors share."""
    path = f"{state_root(df.sparkSession)}/store/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _current(spark, sf, observed="classified_ts"):
    """Classifications of current contents, and the jobs they are of."""
    jobs = _saved(S.upsert(versions(spark, sf), observed=observed))
    return S.classify_current(versions(spark, sf), jobs), jobs


# --- SQL twins ----------------------------------------------------------------

_H = (
    f"SELECT {X.sql.clean('provider')} AS provider, {X.sql.clean('external_job_id')} AS external_job_id, "
    f"{X.sql.clean('company')} AS company, {X.sql.clean('title')} AS title, {X.sql.clean('location')} AS location, "
    f"{X.sql.clean('url')} AS url, {X.sql.clean('description')} AS description, seq, observed_ts, "
    f"CAST(json_object('seq', seq) AS VARCHAR) AS raw_json, "
    f"{X.sql.content_hash('company', 'title', 'location', 'url', 'description')} AS content_hash FROM {{src}}"
)
_FEED = (
    "SELECT *, _prev IS NULL AS is_new, (_prev IS NULL OR content_hash <> _prev) AS changed FROM "
    f"(SELECT *, lag(content_hash) OVER (PARTITION BY {K} ORDER BY observed_ts, seq) AS _prev FROM {{p}}h) x"
)
_FEED2 = (
    f"SELECT *, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY observed_ts, seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM {p}feed"
)
_ATTRS = ("company", "title", "location", "url", "description", "content_hash", "raw_json")
_ISL = (
    f"SELECT {K}, island, "
    + ", ".join(f"first({a} ORDER BY observed_ts, seq) AS {a}" for a in _ATTRS)
    + f", list_reduce(list(observed_ts ORDER BY observed_ts, seq), lambda acc, x: CASE WHEN x - acc >= {T} THEN x ELSE acc END) AS last_seen_ts"
    + f", min(observed_ts) AS first_ts FROM {{p}}feed2 GROUP BY {K}, island"
)
_JOBS = (
    "SELECT provider, first(company ORDER BY island DESC) AS company, external_job_id, "
    + ", ".join(f"first({a} ORDER BY island DESC) AS {a}" for a in _ATTRS[1:])
    + f", min(first_ts) AS first_seen_ts, first(last_seen_ts ORDER BY island DESC) AS last_seen_ts FROM {{p}}isl GROUP BY {K}"
)
_FIRSTS = (
    f"SELECT {K}, content_hash, "
    + ", ".join(f"first({a} ORDER BY observed_ts, seq) AS {a}" for a in ("company", "title", "location", "url", "description"))
    + f", min(observed_ts) AS classified_ts FROM {{p}}feed2 WHERE changed{{extra}} GROUP BY {K}, content_hash"
)
_CLS_COLS = (
    f"{K}, content_hash, model, role_family, role_type, seniority, location_fit, relevance_score, confidence, "
    f"substring(reason, 1, {R.REASON_LIMIT}) AS reason, '{RAW_RESPONSE}' AS raw_response_json, classified_ts"
)


def store_ctes(src: str = "v_versions", with_cls: bool = False, p: str = "", firsts_extra: str = ""):
    """CTEs h, feed, feed2, isl, jobs (+ firsts, cls), names prefixed with ``p``."""
    def fill(t: str, **kw) -> str:
        for k, v in kw.items():
            t = t.replace("{" + k + "}", v)
        return t

    ctes = [(f"{p}h", fill(_H, src=src)), (f"{p}feed", fill(_FEED, p=p)), (f"{p}feed2", fill(_FEED2, p=p)),
            (f"{p}isl", fill(_ISL, p=p)), (f"{p}jobs", fill(_JOBS, p=p))]
    if with_cls:
        ctes += [(f"{p}firsts", fill(_FIRSTS, p=p, extra=firsts_extra)),
                 (f"{p}cls", f"SELECT {_CLS_COLS} FROM ({C.sql_classify(p + 'firsts')}) c")]
    return ctes


def sql_store(body: str, with_cls: bool = False) -> str:
    return with_views(["v_versions"], body, store_ctes(with_cls=with_cls))


def _sql_two_stores(body: str) -> str:
    """State store (before cutoff) as s_*; batch firsts (at/after cutoff) as bfirsts."""
    state = store_ctes(f"(SELECT * FROM v_versions WHERE observed_ts < {CUTOFF_TS})", True, "s_")
    full = store_ctes("v_versions", False)
    batch = [("bfirsts", _FIRSTS.replace("{p}", "").replace("{extra}", f" AND observed_ts >= {CUTOFF_TS}"))]
    return with_views(["v_versions"], body, state + full + batch)


# --- change feed / upsert -------------------------------------------------------


@register("posting_changes", ids="W4 X7",
          sql=lambda: sql_store("SELECT seq, provider, external_job_id, content_hash, observed_ts, is_new, changed FROM feed2"))
def posting_changes(spark, sf):
    return S.change_feed(versions(spark, sf)).select("seq", "provider", "external_job_id", "content_hash", "observed_ts", "is_new", "changed")


@register("job_upsert", ids="W5 W6 J4 S7 X20",
          sql=lambda: sql_store("SELECT * FROM jobs"))
def job_upsert(spark, sf):
    return _jobs(spark, sf)


@register("job_upsert_incremental", ids="W4-W6 R2 (state + batch == one shot)",
          sql=lambda: sql_store("SELECT * FROM jobs"))
def job_upsert_incremental(spark, sf):
    v = versions(spark, sf)
    state = S.upsert(v.where(F.col("observed_ts") < CUTOFF_TS))
    return S.upsert(v.where(F.col("observed_ts") >= CUTOFF_TS), state=state)


@register("last_seen_throttled", ids="W6",
          sql=lambda: sql_store("SELECT provider, external_job_id, first_seen_ts, last_seen_ts FROM jobs"))
def last_seen_throttled(spark, sf):
    return _jobs(spark, sf).select("provider", "external_job_id", "first_seen_ts", "last_seen_ts")


@register("sink_rejects", ids="S18 F15",
          sql=lambda: with_views(["v_versions"], f"""SELECT seq, provider, external_job_id,
              'Normalized job is missing required field: ' || CASE WHEN length({X.sql.clean('provider')}) = 0 THEN 'provider'
                   WHEN length({X.sql.clean('company')}) = 0 THEN 'company'
                   WHEN length({X.sql.clean('external_job_id')}) = 0 THEN 'external_job_id' ELSE 'title' END AS reason
              FROM (SELECT seq, provider, external_job_id, company,
                           CASE WHEN seq % 7 = 0 THEN ' ' ELSE title END AS title FROM v_versions) v
              WHERE NOT {__import__('jobsignal.functions.predicates', fromlist=['sql']).sql.required_present('provider', 'company', 'external_job_id', 'title')}"""))
def sink_rejects(spark, sf):
    v = v_versions(spark, sf).withColumn("title", F.when(F.col("seq") % 7 == 0, F.lit(" ")).otherwise(F.col("title")))
    _, rejected = S.split_required(v.select("seq", "provider", "external_job_id", "company", "title"))
    return rejected.select("seq", "provider", "external_job_id", "reason")


# --- classifications --------------------------------------------------------------


@register("tbl_classifications", ids="S8 C9 C8",
          sql=lambda: sql_store("SELECT * FROM cls", with_cls=True))
def tbl_classifications(spark, sf):
    return _classifications(spark, sf)


def _batch_firsts(spark, sf):
    """Batch = first changed observation per (key, hash) at or after the cutoff."""
    feed = S.change_feed(versions(spark, sf)).where(F.col("changed") & (F.col("observed_ts") >= CUTOFF_TS))
    first = feed.groupBy(*S.KEY, "content_hash").agg(
        F.min_by(F.struct(*S.ATTRS, F.col("observed_ts")), F.struct("observed_ts", "seq")).alias("_a"))
    return first.select(*S.KEY, "content_hash", *[F.col(f"_a.{c}").alias(c) for c in S.ATTRS], F.col("_a.observed_ts").alias("observed_ts"))


def _state_cls(spark, sf):
    v = versions(spark, sf).where(F.col("observed_ts") < CUTOFF_TS)
    return S.classify_versions(v)


@register("classification_cache_miss", ids="J2",
          sql=lambda: _sql_two_stores(f"""SELECT b.provider, b.external_job_id, b.content_hash FROM bfirsts b
              WHERE NOT EXISTS (SELECT 1 FROM s_cls c WHERE c.provider = b.provider AND c.external_job_id = b.external_job_id
                                AND c.content_hash = b.content_hash AND c.model = '{MODEL}')"""))
def classification_cache_miss(spark, sf):
    _, misses = S.cache_split(_batch_firsts(spark, sf), _state_cls(spark, sf), MODEL)
    return misses.select("provider", "external_job_id", "content_hash")


@register("classify_if_needed", ids="C9 J2 F9 R3",
          sql=lambda: _sql_two_stores(f"""
              SELECT c.provider, c.external_job_id, c.content_hash, true AS cache_hit, c.role_family, c.relevance_score, c.classified_ts
              FROM bfirsts b JOIN s_cls c USING (provider, external_job_id, content_hash)
              UNION ALL
              SELECT provider, external_job_id, content_hash, false AS cache_hit, role_family, relevance_score, classified_ts
              FROM ({C.sql_classify("(SELECT b.*, b.classified_ts AS observed_ts FROM bfirsts b WHERE NOT EXISTS (SELECT 1 FROM s_cls c WHERE c.provider = b.provider AND c.external_job_id = b.external_job_id AND c.content_hash = b.content_hash))")}) x"""))
def classify_if_needed(spark, sf):
    out = S.classify_if_needed(_batch_firsts(spark, sf), _saved(_state_cls(spark, sf)))
    return out.select("provider", "external_job_id", "content_hash", "cache_hit", "role_family", "relevance_score", "classified_ts")


@register("classification_upsert", ids="C10",
          sql=lambda: _sql_two_stores(f"""
              SELECT provider, external_job_id, content_hash, model,
                     arg_max(role_family, _o) AS role_family, arg_max(relevance_score, _o) AS relevance_score,
                     arg_max(classified_ts, _o) AS classified_ts
              FROM (SELECT provider, external_job_id, content_hash, model, role_family, relevance_score, classified_ts, 0 AS _src,
                           classified_ts AS _o FROM s_cls
                    UNION ALL
                    SELECT provider, external_job_id, content_hash, model, role_family, relevance_score, classified_ts, 1 AS _src,
                           classified_ts + 10000000000 AS _o
                    FROM ({C.sql_classify("(SELECT b.*, b.classified_ts AS observed_ts FROM bfirsts b)")}) x) u
              GROUP BY ALL"""))
def classification_upsert(spark, sf):
    b = _batch_firsts(spark, sf).withColumn("classified_ts", F.col("observed_ts"))
    new = S.to_classification_rows(C.classify(b))
    out = S.classification_upsert(_state_cls(spark, sf), new)
    return out.select("provider", "external_job_id", "content_hash", "model", "role_family", "relevance_score", "classified_ts")


@register("current_classifications", ids="J1",
          sql=lambda: sql_store("SELECT c.provider, c.external_job_id, c.content_hash, c.role_type, c.relevance_score FROM cls c JOIN jobs j USING (provider, external_job_id, content_hash)", True))
def current_classifications(spark, sf):
    cur = S.current_classifications(*_current(spark, sf))
    return cur.select("provider", "external_job_id", "content_hash", "role_type", "relevance_score")


# --- intelligence reports -----------------------------------------------------------

_CUR = "SELECT c.*, j.company, j.title, j.location AS job_location, j.url FROM cls c JOIN jobs j USING (provider, external_job_id, content_hash)"
TH = R.clamp_threshold(R.DEFAULT_MIN_RELEVANCE_SCORE)


@register("total_jobs", ids="A1", sql=lambda: sql_store("SELECT count(*) AS total_jobs FROM jobs"))
def total_jobs(spark, sf):
    return REP.total_jobs(_jobs(spark, sf))


@register("classified_jobs", ids="A2",
          sql=lambda: sql_store("SELECT count(*) AS classified_jobs FROM (SELECT DISTINCT provider, external_job_id FROM cls) d", True))
def classified_jobs(spark, sf):
    return REP.classified_jobs(_classifications(spark, sf))


@register("high_relevance_jobs", ids="A3 J1",
          sql=lambda: sql_store(f"SELECT count(*) AS high_relevance_jobs FROM ({_CUR}) x WHERE relevance_score >= {TH}", True))
def high_relevance_jobs(spark, sf):
    return REP.high_relevance_jobs(*_current(spark, sf, observed=None), TH)  # a test fixes that its plan scans the history once


@register("role_type_distribution", ids="A4",
          sql=lambda: sql_store(f"SELECT role_type, count(*) AS count FROM ({_CUR}) x GROUP BY role_type", True))
def role_type_distribution(spark, sf):
    return REP.distribution(*_current(spark, sf), "role_type")


@register("seniority_distribution", ids="A5",
          sql=lambda: sql_store(f"SELECT seniority, count(*) AS count FROM ({_CUR}) x GROUP BY seniority", True))
def seniority_distribution(spark, sf):
    return REP.distribution(*_current(spark, sf), "seniority")


@register("top_role_types", ids="T2",
          sql=lambda: sql_store(f"SELECT role_type, count(*) AS count FROM ({_CUR}) x GROUP BY role_type ORDER BY count DESC, role_type LIMIT {R.DISTRIBUTION_ROWS}", True))
def top_role_types(spark, sf):
    return REP.top_distribution(*_current(spark, sf), "role_type", R.DISTRIBUTION_ROWS)


@register("latest_high_relevance", ids="T1 J1",
          sql=lambda: sql_store(f"""SELECT provider, company, title, job_location AS location, url, role_type, seniority, location_fit,
              relevance_score, confidence, reason, classified_ts FROM ({_CUR}) x WHERE relevance_score >= {TH}
              ORDER BY classified_ts DESC, relevance_score DESC, provider, external_job_id LIMIT {R.LATEST_HIGH_RELEVANCE}""", True))
def latest_high_relevance(spark, sf):
    return REP.latest_high_relevance(*_current(spark, sf), TH, R.LATEST_HIGH_RELEVANCE)


@register("intelligence_snapshot", ids="A20 S15")
def intelligence_snapshot(spark, sf):
    current, jobs = _current(spark, sf)
    return REP.intelligence_snapshot(_classifications(spark, sf), jobs, TH, current=_saved(current))
