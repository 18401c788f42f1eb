"""Intelligence and dashboard reports.

Every report is an aggregate (map-side partial aggregation, so a hot label or
board costs one small partial row per task) or a global top-k
(TakeOrderedAndProject: per-partition top-k, then a bounded merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsignal.operators import store as S


def total_jobs(jobs: DataFrame) -> DataFrame:
    """A1."""
    return jobs.agg(F.count(F.lit(1)).alias("total_jobs"))


def classified_jobs(classifications: DataFrame) -> DataFrame:
    """A2: distinct jobs with any classification (any hash, any model)."""
    return classifications.select(*S.KEY).distinct().agg(F.count(F.lit(1)).alias("classified_jobs"))


def current(classifications: DataFrame, jobs: DataFrame, model: str | None = None) -> DataFrame:
    c = classifications if model is None else classifications.where(F.col("model") == model)
    return S.current_classifications(c, jobs)


def high_relevance_jobs(classifications: DataFrame, jobs: DataFrame, threshold: int, model: str | None = None) -> DataFrame:
    """A3: rows (not jobs) of current classifications at or above the threshold."""
    # Conditional count rather than a Filter: a Filter on a classifier output would be
    # pushed below the classifier projection and re-evaluate it.
    cur = current(classifications, jobs, model)
    return cur.agg(F.count(F.when(F.col("relevance_score") >= threshold, F.lit(1))).alias("high_relevance_jobs"))


def distribution(classifications: DataFrame, jobs: DataFrame, label: str, model: str | None = None) -> DataFrame:
    """A4/A5: label -> count over current classifications."""
    return current(classifications, jobs, model).groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def top_distribution(classifications: DataFrame, jobs: DataFrame, label: str, n: int, model: str | None = None) -> DataFrame:
    """Distribution ordered count desc, label; first n."""
    return distribution(classifications, jobs, label, model).orderBy(F.desc("count"), F.asc(label)).limit(n)


def latest_high_relevance(classifications: DataFrame, jobs: DataFrame, threshold: int, n: int,
                          model: str | None = None) -> DataFrame:
    """Newest high-relevance current classifications (natural key breaks ties)."""
    cur = current(classifications, jobs, model).withColumn("_ok", F.col("relevance_score") >= threshold)
    # Qualifying rows sort first; the filter runs after the bounded top-k (not pushed down).
    top = cur.orderBy(F.desc("_ok"), F.desc("classified_ts"), F.desc("relevance_score"), "provider", "external_job_id").limit(n)
    top = top.where("_ok")
    return top.select("provider", "company", "title", F.col("job_location").alias("location"), "url", "role_type",
                      "seniority", "location_fit", "relevance_score", "confidence", "reason", "classified_ts")


def intelligence_snapshot(classifications: DataFrame, jobs: DataFrame, threshold: int, limit: int = 20,
                          model: str | None = None, current: DataFrame | None = None) -> DataFrame:
    """One row; list sections are bounded (top-k / label domains) before nesting.
    The sections are scalar subqueries of the one-row total (no joins).  ``current`` holds
    the classifications of current contents where they are known already."""
    seen = classifications if current is None else current
    def as_list(df: DataFrame, order) -> DataFrame:
        row = F.struct(*df.columns).alias("r")
        return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, row))), lambda x: x["r"])))

    latest = latest_high_relevance(seen, jobs, threshold, limit, model)
    roles = distribution(seen, jobs, "role_type", model)
    sen = distribution(seen, jobs, "seniority", model)
    return total_jobs(jobs).select(
        "total_jobs",
        classified_jobs(classifications).scalar().alias("classified_jobs"),
        high_relevance_jobs(seen, jobs, threshold, model).scalar().alias("high_relevance_jobs"),
        as_list(latest, [(-F.col("classified_ts")).alias("k1"), (-F.col("relevance_score")).alias("k2"),
                         F.col("company"), F.col("title")]).scalar().alias("latest_high_relevance_jobs"),
        as_list(roles, [(-F.col("count")).alias("k"), F.col("role_type")]).scalar().alias("role_type_distribution"),
        as_list(sen, [(-F.col("count")).alias("k"), F.col("seniority")]).scalar().alias("seniority_distribution"),
    )
