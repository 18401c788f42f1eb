"""Queries over postings: classifier (C1-C8), predicates (F*), scalars (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.operators import classify as C
from jobsignal.operators import store as S
from jobsignal.plans.registry import register
from jobsignal.sources.testdata import v_postings, with_views

ID_COLS = "doc_id, provider, company, external_job_id"


def _p(spark, sf):
    return v_postings(spark, sf)


# --- flagship --------------------------------------------------------------


@register("classify_jobs", ids="C8 C1-C7 X5 X21",
          sql=lambda: with_views(["v_postings"], "SELECT * EXCLUDE (url, description) FROM (" + C.sql_classify("v_postings") + ") c"))
def classify_jobs(spark, sf):
    return C.classify(_p(spark, sf)).drop("url", "description")


@register("role_family", ids="C1",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, role_family, family_score FROM (" + C.sql_classify("v_postings") + ") c"))
def role_family(spark, sf):
    return C.classify(_p(spark, sf)).select("doc_id", "role_family", "family_score")


@register("role_type", ids="C2",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, role_type, type_score FROM (" + C.sql_classify("v_postings") + ") c"))
def role_type(spark, sf):
    return C.classify(_p(spark, sf)).select("doc_id", "role_type", "type_score")


@register("seniority", ids="C3",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, seniority, seniority_score FROM (" + C.sql_classify("v_postings") + ") c"))
def seniority(spark, sf):
    return C.classify(_p(spark, sf)).select("doc_id", "seniority", "seniority_score")


@register("location_fit", ids="C4 F13 F14",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {C.sql_location_fit(X.sql.norm_text('location'))} AS location_fit FROM v_postings"))
def location_fit(spark, sf):
    return _p(spark, sf).select("doc_id", C.location_fit(X.norm_text(F.col("location"))).alias("location_fit"))


@register("relevance_score", ids="C5",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, relevance_score FROM (" + C.sql_classify("v_postings") + ") c"))
def relevance_score(spark, sf):
    return C.classify(_p(spark, sf)).select("doc_id", "relevance_score")


@register("confidence", ids="C6",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, confidence FROM (" + C.sql_classify("v_postings") + ") c"))
def confidence(spark, sf):
    return C.classify(_p(spark, sf)).select("doc_id", "confidence")


@register("reason", ids="C7",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, reason FROM (" + C.sql_classify("v_postings") + ") c"))
def reason(spark, sf):
    return C.classify(_p(spark, sf)).select("doc_id", "reason")


@register("is_relevant", ids="F8 X25",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, relevance_score, coalesce(relevance_score >= {R.clamp_threshold(R.DEFAULT_MIN_RELEVANCE_SCORE)}, false) AS is_relevant FROM (" + C.sql_classify("v_postings") + ") c"))
def is_relevant(spark, sf):
    c = C.classify(_p(spark, sf))
    return c.select("doc_id", "relevance_score", P.is_relevant(F.col("relevance_score"), R.DEFAULT_MIN_RELEVANCE_SCORE).alias("is_relevant"))


@register("validate_classification", ids="F9",
          sql=lambda: with_views(["v_postings"], "SELECT doc_id, "
                                 + P.sql.valid_classification("role_family", "role_type", "seniority", "location_fit", "reason", "relevance_score", "confidence")
                                 + " AS valid, substring(reason, 1, 500) AS reason FROM (" + C.sql_classify("v_postings") + ") c"))
def validate_classification(spark, sf):
    c = C.classify(_p(spark, sf))
    ok = P.valid_classification(F.col("role_family"), F.col("role_type"), F.col("seniority"), F.col("location_fit"),
                                F.col("reason"), F.col("relevance_score"), F.col("confidence"))
    return c.select("doc_id", ok.alias("valid"), F.substring("reason", 1, R.REASON_LIMIT).alias("reason"))


# --- predicates -------------------------------------------------------------


@register("title_match", ids="F1 X4",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, title, {P.sql.title_matches('title')} AS title_match FROM v_postings"))
def title_match(spark, sf):
    return _p(spark, sf).select("doc_id", "title", P.title_matches(F.col("title")).alias("title_match"))


@register("level_hint", ids="F2",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {P.sql.level_hint('title')} AS level_hint FROM v_postings"))
def level_hint(spark, sf):
    return _p(spark, sf).select("doc_id", P.level_hint(F.col("title")).alias("level_hint"))


@register("us_location", ids="F3",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, location, {P.sql.is_us_location('location')} AS is_us FROM v_postings"))
def us_location(spark, sf):
    return _p(spark, sf).select("doc_id", "location", P.is_us_location(F.col("location")).alias("is_us"))


@register("nonempty_id", ids="F5",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, external_job_id FROM v_postings WHERE {P.sql.nonempty_id('external_job_id')}"))
def nonempty_id(spark, sf):
    return _p(spark, sf).where(P.nonempty_id(F.col("external_job_id"))).select("doc_id", "external_job_id")


@register("deterministic_match", ids="F6 F1 F3 F5",
          sql=lambda: with_views(["v_postings"], f"SELECT {ID_COLS}, title, location FROM v_postings WHERE {P.sql.title_matches('title')} AND {P.sql.nonempty_id('external_job_id')} AND {P.sql.is_us_location('location')}"))
def deterministic_match(spark, sf):
    p = _p(spark, sf)
    cond = P.title_matches(F.col("title")) & P.nonempty_id(F.col("external_job_id")) & P.is_us_location(F.col("location"))
    return p.where(cond).select("doc_id", "provider", "company", "external_job_id", "title", "location")


@register("us_signal", ids="F13",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {P.sql.has_us_signal(X.sql.norm_text('location'))} AS us_signal FROM v_postings"))
def us_signal(spark, sf):
    return _p(spark, sf).select("doc_id", P.has_us_signal(X.norm_text(F.col("location"))).alias("us_signal"))


@register("non_us_hint", ids="F14",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {P.sql.non_us_hint(X.sql.norm_text('location'))} AS non_us_hint FROM v_postings"))
def non_us_hint(spark, sf):
    return _p(spark, sf).select("doc_id", P.non_us_hint(X.norm_text(F.col("location"))).alias("non_us_hint"))


@register("required_fields", ids="F15",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {P.sql.required_present('provider', 'company', 'external_job_id', 'title')} AS ok FROM v_postings"))
def required_fields(spark, sf):
    p = _p(spark, sf)
    return p.select("doc_id", P.required_present(F.col("provider"), F.col("company"), F.col("external_job_id"), F.col("title")).alias("ok"))


# --- scalars ----------------------------------------------------------------


@register("normalize_title", ids="X4",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.normalize_title('title')} AS norm_title FROM v_postings"))
def normalize_title(spark, sf):
    return _p(spark, sf).select("doc_id", X.normalize_title(F.col("title")).alias("norm_title"))


@register("norm_text", ids="X5 X21",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.norm_text(X.sql.truncate('description', R.DESCRIPTION_LIMIT))} AS norm_desc, {X.sql.norm_text('title')} AS norm_title FROM v_postings"))
def norm_text(spark, sf):
    p = _p(spark, sf)
    return p.select("doc_id", X.norm_text(X.truncate(F.col("description"), R.DESCRIPTION_LIMIT)).alias("norm_desc"),
                    X.norm_text(F.col("title")).alias("norm_title"))


@register("compact_text", ids="X2",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.compact_text('description')} AS compact FROM v_postings"))
def compact_text(spark, sf):
    return _p(spark, sf).select("doc_id", X.compact_text(F.col("description")).alias("compact"))


@register("clean", ids="X6",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.clean('description')} AS cleaned, {X.sql.clean('location')} AS location FROM v_postings"))
def clean(spark, sf):
    p = _p(spark, sf)
    return p.select("doc_id", X.clean(F.col("description")).alias("cleaned"), X.clean(F.col("location")).alias("location"))


@register("truncate_text", ids="X21",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.truncate('description', R.DESCRIPTION_LIMIT)} AS desc_head, length({X.sql.truncate('description', R.DESCRIPTION_LIMIT)}) AS n FROM v_postings"))
def truncate_text(spark, sf):
    t = X.truncate(F.col("description"), R.DESCRIPTION_LIMIT)
    return _p(spark, sf).select("doc_id", t.alias("desc_head"), F.length(t).cast("long").alias("n"))


@register("content_hash", ids="X7",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.content_hash('company', 'title', 'location', 'url', 'description')} AS content_hash FROM v_postings"))
def content_hash(spark, sf):
    p = _p(spark, sf)
    return p.select("doc_id", X.content_hash(F.col("company"), F.col("title"), F.col("location"), F.col("url"), F.col("description")).alias("content_hash"))


@register("work_type", ids="X13",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.work_type('location')} AS work_type FROM v_postings"))
def work_type(spark, sf):
    return _p(spark, sf).select("doc_id", X.work_type(F.col("location")).alias("work_type"))


_WORKPLACE = "CASE doc_id % 5 WHEN 0 THEN 'Remote' WHEN 1 THEN ' onsite ' WHEN 2 THEN 'On-Site' WHEN 3 THEN 'Hybrid' ELSE NULL END"


@register("workplace", ids="P12",
          sql=lambda: with_views(["v_postings"], f"SELECT doc_id, {X.sql.ashby_workplace(f'({_WORKPLACE})', 'location')} AS work_type FROM v_postings"))
def workplace(spark, sf):
    p = _p(spark, sf)
    w = (F.when(F.col("doc_id") % 5 == 0, "Remote").when(F.col("doc_id") % 5 == 1, " onsite ")
         .when(F.col("doc_id") % 5 == 2, "On-Site").when(F.col("doc_id") % 5 == 3, "Hybrid"))
    return p.select("doc_id", X.ashby_workplace(w, F.col("location")).alias("work_type"))


@register("posting_url", ids="P15",
          sql=lambda: with_views(["v_postings"], """SELECT doc_id,
              CASE provider WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || company || '/' || external_job_id
                            WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' || company || '/jobs/' || external_job_id
                            ELSE coalesce(NULLIF(CASE WHEN doc_id % 2 = 0 THEN url END, ''), 'https://jobs.lever.co/' || company || '/' || external_job_id) END AS posting_url
              FROM v_postings"""))
def posting_url(spark, sf):
    from jobsignal.operators.alerts import posting_url as url_of

    p = _p(spark, sf)
    apply_url = F.when(F.col("doc_id") % 2 == 0, F.col("url"))
    return p.select("doc_id", url_of(F.col("provider"), F.col("company"), F.col("external_job_id"), apply_url).alias("posting_url"))


# --- F9: payloads of an outside classifier, some of them damaged ------------------------------------

_PAYLOAD = {  # column -> (doc_id divisor, what stands there instead)
    "role_family": (23, "wizard"), "role_type": (29, ""), "seniority": (31, " lead "), "location_fit": (37, None),
    "reason": (19, "  "), "relevance_score": (17, 140), "confidence": (13, -0.5),
}


def classifier_payloads(spark, sf):
    c = C.classify(_p(spark, sf))
    damaged = [F.when(F.col("doc_id") % d == 0, F.lit(v)).otherwise(F.col(n)).alias(n) for n, (d, v) in _PAYLOAD.items()]
    return c.select("doc_id", *damaged)


def _payload_sql(body: str) -> str:
    def literal(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    cols = ", ".join(f"CASE WHEN doc_id % {d} = 0 THEN {literal(v)} ELSE {n} END AS {n}" for n, (d, v) in _PAYLOAD.items())
    return with_views(["v_postings"], body, [("payload", f"SELECT doc_id, {cols} FROM ({C.sql_classify('v_postings')}) c")])


_PROBLEM = P.sql.classification_problem("role_family", "role_type", "seniority", "location_fit", "reason", "relevance_score", "confidence")


@register("classification_rejects", ids="F9",
          sql=lambda: _payload_sql(f"SELECT doc_id, problem FROM (SELECT doc_id, {_PROBLEM} AS problem FROM payload) p WHERE problem IS NOT NULL"))
def classification_rejects(spark, sf):
    _, rejected = S.split_classifications(classifier_payloads(spark, sf))
    return rejected.select("doc_id", "problem")


@register("accepted_classifications", ids="F9",
          sql=lambda: _payload_sql(f"SELECT doc_id, role_family, role_type, seniority, location_fit, relevance_score, substring({X.sql.strip_ws('reason')}, 1, {R.REASON_LIMIT}) AS reason "
                                   f"FROM payload WHERE {_PROBLEM} IS NULL"))
def accepted_classifications(spark, sf):
    valid, _ = S.split_classifications(classifier_payloads(spark, sf))
    return valid.select("doc_id", "role_family", "role_type", "seniority", "location_fit", "relevance_score", "reason")
