"""Landed responses to alerts as one stream.

A micro-batch of landed responses updates the jobs (W4-W6), classifies contents not
classified yet (C9), alerts on first matches (W12, W13), moves the boards' poll state
(J6) and logs every response's outcome (A19), and commits all of it by one manifest
(:mod:`jobsignal.streaming.state`).  It reads and rewrites only the buckets that the
batch's keys touch.

R12: a response that lands as a lost task is an outcome row ``task_exception:{type}``
and leaves the other boards alone.  With ``isolate`` a micro-batch that raises is
withdrawn whole and leaves one outcome ``cycle_exception:{type}`` per service; its
responses stay in the ``failed`` table, and the next micro-batch goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.operators import alerts as A
from jobsignal.operators import classify as C
from jobsignal.operators import normalize as N
from jobsignal.operators import store as S
from jobsignal.sources import landed as L
from jobsignal.streaming.state import BUCKETS, Batch, State, union

KEYS = {"jobs": S.KEY, "classifications": S.KEY, "notified": A.ID, "board_state": A.BOARD}
OUTCOME = ["seq", "service", "source", "fetched_ts", "status", "postings", "new_matches", "detail"]
#: A response holds fewer postings than this; posting order inside the stream is response number times this plus position.
PER_RESPONSE = 1 << 20
#: Keys of late rows that may be sent to all tasks.
FEW = 100_000


def split_late(versions: DataFrame, jobs: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows to apply, late rows): a row older than its job's recorded ``last_seen_ts`` is late."""
    if jobs is None:
        return versions, None
    tagged = versions.join(jobs.select(*S.KEY, F.col("last_seen_ts").alias("_seen")), S.KEY, "left")
    late = F.coalesce(F.col("observed_ts") < F.col("_seen"), F.lit(False))
    return tagged.where(~late).drop("_seen"), tagged.where(late).drop("_seen")


def upsert_jobs(b: Batch, versions: DataFrame, rules: R.Rules = R.DEFAULT_RULES) -> list[int]:
    """R2: new versions into the touched buckets of ``jobs``; late rows go to a table of their own.

    Stored jobs are read and rewritten without their wide fields: these are written once, when a row starts
    a content, and all anew only where most of those on disk are of contents that are gone."""
    touched = b.touched("jobs", versions)
    anew = b.mostly_dead("jobs")
    written = list(range(b.state.buckets)) if anew else touched
    jobs = b.narrow("jobs", written)
    if jobs is not None:
        seen = versions.select(*S.KEY, "observed_ts").join(jobs.select(*S.KEY, "last_seen_ts"), S.KEY)
        seen = b.stage("late-keys", seen.where("observed_ts < last_seen_ts").select(*S.KEY, "last_seen_ts").distinct())
        n = seen.count()
        if n:
            versions, late = split_late(versions, seen if n < FEW else seen.hint("merge"))
        else:
            late = versions.select(*S.KEY, *[c for c in versions.columns if c not in S.KEY]).where(F.lit(False))
        b.append("late", late)
    runs, begun = S.upsert_apart(versions, jobs, rules)
    runs = b.stage("runs", runs)
    content, old = [*S.KEY, "content_hash"], F.col("_v") == 0
    wide = begun(runs)
    if anew:
        stay = b.whole("jobs", jobs).join(runs.where(old).select(*content), content, "left_semi")
        wide = wide.unionByName(stay.select(*wide.columns))
    b.write_apart("jobs", wide, S.JOB_COLUMNS, anew)
    now = F.lit(b.number).cast("long")
    if jobs is None or anew:
        runs = runs.withColumn("_held", now)
    else:
        runs = runs.join(jobs.select(*content, "_held"), content, "left").withColumn("_held", F.when(old, F.col("_held")).otherwise(now))
    b.write("jobs", runs.select(*content, "first_seen_ts", "last_seen_ts", "_held"), written)
    return touched


def classify_new(b: Batch, versions: DataFrame, touched: list[int], rules: R.Rules = R.DEFAULT_RULES) -> None:
    """Contents of the batch, and of the stored jobs in its buckets, that this model has not classified."""
    keys = S.KEY + ["content_hash"]
    rows = S.with_hash(versions).select(*keys, *S.ATTRS, F.col("observed_ts").alias("ts"))
    done = b.read("classifications", touched)
    known = None if done is None else done.where(F.col("model") == rules.model).select(*keys)
    jobs = b.narrow("jobs", touched)
    if jobs is not None:  # keys alone tell whether any stored text is needed
        lack = jobs if known is None else jobs.join(known, keys, "left_anti")
        if lack.limit(1).count():
            rows = rows.unionByName(b.whole("jobs", lack).select(*keys, *S.ATTRS, F.col("last_seen_ts").alias("ts")))
    if known is not None:  # before anything wide is grouped
        rows = rows.join(known, keys, "left_anti")
    flat = rows.groupBy(*keys, *S.ATTRS).agg(F.min("ts").alias("classified_ts"))  # rows of one hash hold the same fields
    rows = S.to_classification_rows(C.classify(flat, rules), rules)
    valid = P.valid_classification(*[F.col(c) for c in ("role_family", "role_type", "seniority", "location_fit", "reason", "relevance_score", "confidence")])
    fresh = b.stage("classified", rows.where(valid))  # so that the texts' shuffle has ended when the results are dealt
    b.write("classifications", union([fresh, done]), touched)


def alert_once(b: Batch, matches: DataFrame) -> DataFrame:
    """The first match of each id that no batch before has alerted; they join ``notified``."""
    firsts = A.first_alerts(matches)
    touched = b.touched("notified", matches)
    seen = b.read("notified", touched)
    if seen is not None:
        firsts = firsts.join(seen.select(*A.ID), A.ID, "left_anti")
    firsts = b.stage("firsts", firsts)
    b.write("notified", union([firsts, seen]), touched)
    return firsts


def update_boards(b: Batch, status: DataFrame) -> None:
    """A successful response replaces a board's poll state, any outcome moves its time."""
    touched = b.touched("board_state", status)
    new = N.board_parts(status)
    old = b.read("board_state", touched)
    if old is not None:
        kept = old.select(*A.BOARD, F.struct("etag", "last_modified", "fingerprint").alias("_old"), F.col("last_seen_ts").alias("_old_ts"))
        new = new.join(kept, A.BOARD, "full").select(*A.BOARD, F.coalesce("_s", "_old").alias("_s"), F.greatest("last_seen_ts", "_old_ts").alias("last_seen_ts"))
    b.write("board_state", N.board_columns(new), touched)


def ingest_batch(b: Batch, responses: DataFrame, rules: R.Rules = R.DEFAULT_RULES) -> None:
    """One micro-batch: every table that its responses change, written but not yet committed."""
    parsed = L.explode_postings(responses)
    order = (F.col("seq") * PER_RESPONSE + F.col("pos")).alias("order")
    postings = b.stage("postings", N.normalize(parsed).select("*", order))
    matches = b.stage("matches", N.posting_matches(parsed).select("*", order))
    versions = A.response_dedupe(postings.withColumn("service", F.col("provider")), ["seq"], "pos").select(
        F.col("order").alias("seq"), *S.KEY, *S.ATTRS, X.canonical_json(F.col("raw")).alias("raw_json"), F.col("fetched_ts").alias("observed_ts"))
    versions = b.stage("versions", versions)
    counts = b.stage("counts", postings.groupBy("seq").agg(F.count(F.lit(1)).alias("postings")))
    b.unstage("postings")
    accepted, rejected = S.split_required(versions)
    b.append("rejects", rejected)
    touched = upsert_jobs(b, accepted, rules)
    classify_new(b, accepted, touched, rules)
    b.unstage("versions")
    firsts = alert_once(b, matches.select(*A.ID, F.col("order").alias("seq"), F.col("seq").alias("response"), F.col("fetched_ts").alias("observed_ts"),
                                          "title", F.col("apply_url").alias("url"), "updated_ms"))
    b.append("alerts", A.chunks(A.message_lines(firsts)))
    status = b.stage("status", N.poll_status(responses))
    update_boards(b, status)
    new = firsts.groupBy(F.col("response").alias("seq")).agg(F.count(F.lit(1)).alias("new_matches"))
    b.append("outcomes", N.outcomes(status, counts, new).select(*OUTCOME))


def failure(e: Exception) -> str:
    """Type of an error: the class Spark names, else Python's."""
    return (e.getCondition() or type(e).__name__) if isinstance(e, PySparkException) else type(e).__name__


def ingest(spark: SparkSession, schema, landing: str, root: str, run: Callable, rules: R.Rules = R.DEFAULT_RULES, isolate: bool = False,
           buckets: int = BUCKETS, step: Callable[[Batch, DataFrame, R.Rules], None] = ingest_batch) -> State:
    """Take all that has landed below ``landing``; returns the committed tables.  Called again, it goes on where it stopped."""
    state = State(spark, root, KEYS, buckets)

    def apply(batch: DataFrame, number: int) -> None:
        b = state.begin(number)
        if b is None:
            return
        try:
            step(b, batch, rules)
        except Exception as e:  # noqa: BLE001
            if not isolate:
                raise
            b = b.abandon()
            b.append("failed", batch)
            lost = batch.groupBy("service").agg(F.min("seq").alias("seq"), F.max("fetched_ts").alias("fetched_ts"))
            zero = F.lit(0).cast("long")
            b.append("outcomes", lost.select("seq", "service", F.lit(None).cast("string").alias("source"), "fetched_ts", F.lit(f"cycle_exception:{failure(e)}").alias("status"),
                                             zero.alias("postings"), zero.alias("new_matches"), F.lit(None).cast("string").alias("detail")))
        b.commit()

    run(spark, schema, landing, f"{root}/chk", apply)
    return state
