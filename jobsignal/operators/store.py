"""Change-aware job store.

The change feed (W4) deals observations of one posting into time buckets, orders rows
inside (posting, bucket) and carries one summary row per bucket.  The snapshot (W5)
is aggregates per (posting, content, second) and one fetch of a wide row per posting;
the throttle (W6) streams a posting's distinct seconds in order and carries one
number.  The same path serves groups of every size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.operators import classify as C

KEY = ["provider", "external_job_id"]
ATTRS = ["company", "title", "location", "url", "description"]
JOB_COLUMNS = KEY[:1] + ["company", "external_job_id", "title", "location", "url", "description",
                         "content_hash", "raw_json", "first_seen_ts", "last_seen_ts"]
CLASS_COLUMNS = ["provider", "external_job_id", "content_hash", "model", "role_family", "role_type", "seniority",
                 "location_fit", "relevance_score", "confidence", "reason", "raw_response_json", "classified_ts"]
BUCKET_SECONDS = 30 * 86400   # time bucket of the change feed
REQUIRED = ("provider", "company", "external_job_id", "title")


def split_required(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected-with-reason)."""
    missing = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        missing = F.when(F.length(X.clean(F.col(c))) == 0, F.lit(c)).otherwise(missing)
    tagged = df.withColumn("_missing", missing)
    accepted = tagged.where(F.col("_missing").isNull()).drop("_missing")
    rejected = tagged.where(F.col("_missing").isNotNull()).select(
        "*", F.concat(F.lit("Normalized job is missing required field: "), F.col("_missing")).alias("reason")
    ).drop("_missing")
    return accepted, rejected


def with_hash(df: DataFrame) -> DataFrame:
    """Clean the stored fields (X6) and add the content hash."""
    cleaned = [X.clean(F.col(c)).alias(c) for c in ["provider", "external_job_id"] + ATTRS]
    rest = [c for c in df.columns if c not in set(KEY + ATTRS)]
    out = df.select(*cleaned, *rest)
    return out.withColumn("content_hash", X.content_hash(*[F.col(c) for c in ("company", "title", "location", "url", "description")], cleaned=True))


def change_feed(versions: DataFrame, state: DataFrame | None = None, ts: str = "observed_ts",
                bucket_seconds: int | None = BUCKET_SECONDS) -> DataFrame:
    """is_new / changed per observation, ordered by (ts, seq) per key.

    ``state`` is the current jobs snapshot; its row acts as version 0 of a key.
    Adds ``island`` = running count of changes (the version an observation belongs to).
    """
    h = with_hash(versions).withColumn("_v", F.lit(1))
    if state is not None:
        s = state.select(
            *KEY, *ATTRS, "content_hash", "raw_json",
            F.lit(-1).cast("long").alias("seq"), F.col("last_seen_ts").alias(ts),
            F.col("first_seen_ts").alias("_first"), F.lit(0).alias("_v"),
        )
        h = h.withColumn("_first", F.col(ts)).unionByName(s, allowMissingColumns=True)
    else:
        h = h.withColumn("_first", F.col(ts))
    if bucket_seconds is not None:
        return _change_feed_bucketed(h, ts, bucket_seconds)
    w = Window.partitionBy(*KEY).orderBy("_v", ts, "seq")
    prev = F.lag("content_hash").over(w)
    out = h.select("*", prev.alias("_prev"))
    out = out.select(
        "*",
        (F.col("_prev").isNull() & (F.col("_v") == 1)).alias("is_new"),
        (F.col("_prev").isNull() | (F.col("content_hash") != F.col("_prev"))).alias("changed"),
    )
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("island", F.sum(F.col("changed").cast("int")).over(running)).drop("_prev")


def _change_feed_bucketed(h: DataFrame, ts: str, bucket_seconds: int) -> DataFrame:
    """Two-level W4 for postings observed very often: ``lag`` and the running change
    count inside (posting, time bucket); the previous hash and the change count
    carried into a bucket come from one summary row per bucket."""
    order = F.struct(F.col("_v"), F.col(ts), F.col("seq"))
    h = h.withColumn("_b", F.when(F.col("_v") == 0, F.lit(-(2 ** 40))).otherwise(F.floor(F.col(ts) / bucket_seconds)))
    w_in = Window.partitionBy(*KEY, "_b").orderBy("_v", ts, "seq")
    h = h.withColumn("_prev_in", F.lag("content_hash").over(w_in))
    wb = Window.partitionBy(*KEY).orderBy("_b")
    last = h.groupBy(*KEY, "_b").agg(F.max_by("content_hash", order).alias("_last"))
    last = last.select(*KEY, "_b", F.lag("_last").over(wb).alias("_before"))
    h = h.join(last, KEY + ["_b"], "left").withColumn("_prev", F.coalesce(F.col("_prev_in"), F.col("_before")))
    h = h.select("*", (F.col("_prev").isNull() & (F.col("_v") == 1)).alias("is_new"),
                 (F.col("_prev").isNull() | (F.col("content_hash") != F.col("_prev"))).alias("changed"))
    run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("_local", F.sum(F.col("changed").cast("int")).over(run))
    cnt = h.groupBy(*KEY, "_b").agg(F.sum(F.col("changed").cast("int")).alias("_n"))
    cnt = cnt.select(*KEY, "_b", F.coalesce(F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    h = h.join(cnt, KEY + ["_b"], "left").withColumn("island", (F.col("_carry") + F.col("_local")).cast("long"))
    return h.drop("_b", "_prev_in", "_before", "_prev", "_local", "_carry")


def recorded(times: DataFrame, group: list[str], interval: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """W6 over rows (group, ``_t``, ``_start``): the value recorded last, one row per group.
    Without ``_start`` the first row of a group, by (``_v``, ``_t``), records, and is told as
    (``_v``, ``_start``); a null time records nothing.  ``kept`` names columns that are equal
    within a group and go along.

    The rule is a chain, each recorded time decides the next, so the times of a group
    are read in order as a stream that carries one number: the shuffle sorts (and
    spills) them, a task holds one Arrow batch, and a jump to the next recorded time is
    a binary search.  No row or array holds a posting's history."""
    given = "_start" in times.columns
    carried = [*group, *kept]
    schema = T.StructType([*[times.schema[c] for c in carried], *[T.StructField(c, T.LongType()) for c in ("_v", "_start", "_last")]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, last = None, None, None  # the open group's columns, as one row, (_v, _t) of its first row, its recorded value

        def closed(columns, opened, values):
            told = [pa.array(x, pa.int64()) for x in (*zip(*opened), values)]
            return pa.RecordBatch.from_arrays([*columns, *told], names=schema.fieldNames())

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c) for c in carried]
            keys = columns[:len(group)]
            t = pc.fill_null(batch.column("_t"), -(2 ** 63)).to_numpy()
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys])
            goes_on = held is not None and all(h[0].as_py() == k[0].as_py() for h, k in zip(held, keys))
            firsts = np.flatnonzero(new)
            if held is not None and not goes_on:
                yield closed(held, [first], [last])
            heads = pa.array(firsts)
            opened = list(zip([1] * len(firsts) if given else batch.column("_v").take(heads).to_pylist(),
                              batch.column("_start" if given else "_t").take(heads).to_pylist()))
            values = [o[1] for o in opened]
            if goes_on:
                opened[0], values[0] = first, last
            ends = np.append(firsts[1:], n)
            # the row that opens a group may be a stored one, later than others; those are in order
            begin = firsts if given else firsts + 1
            if goes_on:
                begin = np.append(0, begin[1:])
            for i in np.flatnonzero(ends > begin).tolist():
                at, b, value = int(begin[i]), int(ends[i]), values[i]
                if value is None:
                    continue
                while (at := at + int(np.searchsorted(t[at:b], value + interval))) < b:
                    value = int(t[at])
                values[i] = value
            if len(values) > 1:
                yield closed([c.take(heads[:-1]) for c in columns], opened[:-1], values[:-1])
            held, first, last = [c.take(heads[-1:]) for c in columns], opened[-1], values[-1]
        if held is not None:
            yield closed(held, [first], [last])

    order = ["_t"] if given else ["_v", "_t"]
    return times.select(*carried, *order, *(["_start"] if given else [])).repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(fold, schema)


def throttle(feed: DataFrame, interval: int, group: list[str], ts: str) -> DataFrame:
    """The last recorded time of each group.

    The first observation (a stored row before any of the batch, ``_v`` 0) records;
    later ones, by time, record when at least ``interval`` seconds after the value
    recorded last.  Groups whose times all lie within an interval record nothing more;
    only the others' distinct seconds are read in order."""
    new = F.when(F.col("_v") == 1, F.col(ts))
    ends = feed.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("_v") == 0, F.col(ts))), F.min(new)).alias("_start"), F.max(new).alias("_end"))
    more = ends.where(F.col("_end") >= F.col("_start") + interval).select(*group, "_start")
    seconds = feed.where(F.col("_v") == 1).select(*group, F.col(ts).alias("_t")).distinct().join(more, group)
    moved = recorded(seconds.where(F.col("_t") >= F.col("_start") + interval), group, interval)
    return ends.join(moved.select(*group, "_last"), group, "left").select(*group, F.coalesce("_last", "_start").alias("_last"))


def upsert(versions: DataFrame, state: DataFrame | None = None, rules: R.Rules = R.DEFAULT_RULES,
           ts: str = "observed_ts", bucket_seconds: int | None = BUCKET_SECONDS, observed: str | None = None) -> DataFrame:
    """New jobs snapshot after applying ``versions`` to ``state``.

    A posting's current content is that of its last observation, and it holds since the
    last observation of another content.  Both come from narrow rows dealt once by
    (posting, content): one aggregate, and one stream of the observations the current
    content holds for.  Wide rows are touched once, to fetch the one that started the
    current content.  A stored posting keeps its ``first_seen_ts``,
    whatever the batch's times.  ``observed`` names a further column: the time at which
    ``versions`` first hold the current content.  ``bucket_seconds`` None: by windows over
    the change feed (the plain form that tests compare with)."""
    if bucket_seconds is None:
        return _upsert_by_feed(versions, state, rules, ts)
    rows, content = _observations(versions, ts), [*KEY, "content_hash"]
    starts, mine = _current(rows, state, rules, observed)
    if state is not None:
        rows = rows.unionByName(_stored(state).select(*rows.columns))
    along = ["first_seen_ts", *(["_lo"] if observed else [])]
    begun = mine(rows.join(starts.withColumnsRenamed({"_v": "_v0"}), content).where((F.col("_v") == F.col("_v0")) & (F.col("_t") == F.col("_start"))))
    begun = begun.groupBy(*content).agg(F.min_by(F.struct(*ATTRS, "raw_json"), "seq").alias("_a"), *[F.first(c).alias(c) for c in (*along, "_last")])
    return begun.select(
        "provider", F.col("_a.company").alias("company"), "external_job_id", *[F.col(f"_a.{c}").alias(c) for c in ("title", "location", "url", "description")],
        "content_hash", F.col("_a.raw_json").alias("raw_json"), "first_seen_ts", F.col("_last").alias("last_seen_ts"),
        *([F.col("_lo").alias(observed)] if observed else []))


def upsert_apart(versions: DataFrame, state: DataFrame | None = None, rules: R.Rules = R.DEFAULT_RULES,
                 ts: str = "observed_ts") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """:func:`upsert` for jobs that keep their wide fields apart; ``state`` holds ``KEY``, ``content_hash`` and the times only.

    Returns the jobs' narrow columns (``_v`` 0: the stored row's wide fields stay) and what fetches, for these
    rows once they are written, the wide fields of those that a row of ``versions`` has started."""
    rows, content = _observations(versions, ts), [*KEY, "content_hash"]
    starts, mine = _current(rows, state, rules)

    def begun(starts: DataFrame) -> DataFrame:
        new = starts.where("_v = 1").select(*content, "_start", "_other")
        held = mine(rows.join(new, content).where(F.col("_t") == F.col("_start")))
        held = held.groupBy(*content).agg(F.min_by(F.struct(*ATTRS, "raw_json"), "seq").alias("_a"))
        return held.select(*content, *[F.col(f"_a.{c}").alias(c) for c in (*ATTRS, "raw_json")])

    return starts.where(F.col("_start").isNotNull()).select(*content, "first_seen_ts", F.col("_last").alias("last_seen_ts"), "_v", "_start", "_other"), begun


def _observations(versions: DataFrame, ts: str) -> DataFrame:
    hashed = with_hash(versions).withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    return hashed.withColumn("_t", F.col(ts)).withColumn("_v", F.lit(1)).select(*KEY, *ATTRS, "content_hash", "raw_json", "seq", "_t", "_v")


def _stored(state: DataFrame) -> DataFrame:
    return state.withColumn("seq", F.lit(-1).cast("long")).withColumn("_t", F.col("last_seen_ts")).withColumn("_v", F.lit(0))


def _current(rows: DataFrame, state: DataFrame | None, rules: R.Rules, observed: str | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(one narrow row per posting: its current content, the observation that starts it and its last recorded time;
    the filter to observations that a content holds for)."""
    content = [*KEY, "content_hash"]
    place = F.struct("_v", "_t", "seq")
    narrow, by_content = rows.select(*content, "_v", "_t", "seq"), [F.max(place).alias("_m"), F.min(F.when(F.col("_v") == 1, F.col("_t"))).alias("_lo")]
    if state is None:
        by_content.append(F.lit(None).cast("long").alias("_first"))
    else:
        narrow = narrow.withColumn("_first", F.lit(None).cast("long")).unionByName(_stored(state).select(*content, "_v", "_t", "seq", F.col("first_seen_ts").alias("_first")))
        by_content.append(F.max("_first").alias("_first"))
    # both uses below read all columns of ``dealt`` and put no filter on it, so its scan and shuffle are shared
    dealt = narrow.repartition(*content)
    contents = dealt.groupBy(*content).agg(*by_content)
    by_key = Window.partitionBy(*KEY)  # one row per content of a posting
    latest = by_key.orderBy(F.desc("_m"))
    current = contents.select(*content, F.row_number().over(latest).alias("_rn"), F.lead("_m").over(latest).alias("_other"), "_lo",
                              F.coalesce(F.max("_first").over(by_key), F.min("_lo").over(by_key)).alias("first_seen_ts")).where("_rn = 1").drop("_rn")

    def mine(df: DataFrame) -> DataFrame:
        return df.where(F.col("_other").isNull() | (place > F.col("_other")))

    along = ["first_seen_ts", *(["_lo"] if observed else [])]
    return recorded(mine(dealt.join(current, content)), content, rules.last_seen_interval, (*along, "_other", *([] if state is None else ["_first"]))), mine


def _upsert_by_feed(versions: DataFrame, state: DataFrame | None, rules: R.Rules, ts: str) -> DataFrame:
    feed = change_feed(versions, state, ts, None)
    order = F.struct(F.col("_v"), F.col(ts).alias("ts"), F.col("seq"))
    group = KEY + ["island"]
    per_island = feed.groupBy(*group).agg(
        F.min_by(F.struct(*ATTRS, "content_hash", "raw_json"), order).alias("_a"), F.min_by("_first", order).alias("_first"))
    per_key = per_island.groupBy(*KEY).agg(F.max_by("_a", "island").alias("_a"), F.min_by("_first", "island").alias("first_seen_ts"),
                                           F.max("island").alias("island"))
    current = feed.join(per_key.select(*group), group, "left_semi")
    out = per_key.join(throttle(current, rules.last_seen_interval, group, ts), group)
    return out.select(
        "provider", F.col("_a.company").alias("company"), "external_job_id",
        *[F.col(f"_a.{c}").alias(c) for c in ("title", "location", "url", "description", "content_hash", "raw_json")],
        "first_seen_ts", F.col("_last").alias("last_seen_ts"),
    )


def classify_versions(versions: DataFrame, rules: R.Rules = R.DEFAULT_RULES, ts: str = "observed_ts") -> DataFrame:
    """C9 for a whole history: each (key, content hash) is classified once, at its
    first observation (later returns of the same content are cache hits)."""
    return to_classification_rows(C.classify(first_contents(versions, ts), rules), rules)


def first_contents(versions: DataFrame, ts: str = "observed_ts") -> DataFrame:
    """Each content of each posting as first observed: one aggregate, no ordering of the history.
    Rows of one hash hold the same fields, so the fields are keys and a number is aggregated."""
    return with_hash(versions).groupBy(*KEY, "content_hash", *ATTRS).agg(F.min(ts).alias("classified_ts"))


def classify_current(versions: DataFrame, jobs: DataFrame, rules: R.Rules = R.DEFAULT_RULES, ts: str = "observed_ts") -> DataFrame:
    """J1 over C9: classifications of the jobs' current contents only; the join comes before the classifier.
    A job holds the fields of its content; the versions give the time of its first observation,
    unless the jobs have it already (``classified_ts``, see ``upsert``)."""
    known = jobs.select(*KEY, "content_hash", *ATTRS, *[c for c in jobs.columns if c == "classified_ts"])
    if "classified_ts" not in jobs.columns:
        known = known.join(with_hash(versions).groupBy(*KEY, "content_hash").agg(F.min(ts).alias("classified_ts")), KEY + ["content_hash"])
    return to_classification_rows(C.classify(known, rules), rules)


def to_classification_rows(classified: DataFrame, rules: R.Rules = R.DEFAULT_RULES) -> DataFrame:
    raw = F.lit(json.dumps({"engine": rules.model, "source": "local_classifier"}, sort_keys=True))
    return classified.select(
        *KEY, "content_hash", "model", "role_family", "role_type", "seniority", "location_fit",
        "relevance_score", "confidence", F.substring("reason", 1, R.REASON_LIMIT).alias("reason"),
        raw.alias("raw_response_json"), "classified_ts",
    )


def cache_split(batch: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of batch rows against the classification cache on (key, hash, model)."""
    keys = cache.where(F.col("model") == model).select(*KEY, "content_hash").distinct()
    return (batch.join(keys, KEY + ["content_hash"], "left_semi"),
            batch.join(keys, KEY + ["content_hash"], "left_anti"))


def classify_if_needed(batch: DataFrame, cache: DataFrame, rules: R.Rules = R.DEFAULT_RULES,
                       ts: str = "observed_ts") -> DataFrame:
    """Cached classification when present, otherwise classify now (F9-validated)."""
    hits, misses = cache_split(batch, cache, rules.model)
    cached = hits.select(*KEY, "content_hash").join(
        cache.where(F.col("model") == rules.model), KEY + ["content_hash"], "inner"
    ).withColumn("cache_hit", F.lit(True))
    fresh = to_classification_rows(
        C.classify(misses.withColumn("classified_ts", F.col(ts)), rules), rules
    )
    valid = P.valid_classification(*[F.col(c) for c in ("role_family", "role_type", "seniority", "location_fit", "reason", "relevance_score", "confidence")])
    fresh = fresh.where(valid).withColumn("cache_hit", F.lit(False))
    return cached.select(*CLASS_COLUMNS, "cache_hit").unionByName(fresh.select(*CLASS_COLUMNS, "cache_hit"))


def split_classifications(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, their reason cut; rejected rows with ``problem``).  Nothing is lost: a row is in one of the two."""
    judged = rows.withColumn("problem", P.classification_problem(*[F.col(c) for c in (
        "role_family", "role_type", "seniority", "location_fit", "reason", "relevance_score", "confidence")]))
    valid = judged.where(F.col("problem").isNull()).drop("problem")
    return valid.withColumn("reason", F.substring(X.strip_ws(F.col("reason")), 1, R.REASON_LIMIT)), judged.where(F.col("problem").isNotNull())


def classification_upsert(state: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (key, hash, model); the new row overwrites every value."""
    tagged = state.select(*CLASS_COLUMNS, F.lit(0).alias("_src")).unionByName(new.select(*CLASS_COLUMNS, F.lit(1).alias("_src")))
    best = tagged.groupBy(*KEY, "content_hash", "model").agg(
        F.max_by(F.struct(*[c for c in CLASS_COLUMNS if c not in KEY + ["content_hash", "model"]]),
                 F.struct("_src", "classified_ts")).alias("_r")
    )
    return best.select(*KEY, "content_hash", "model", *[F.col(f"_r.{c}").alias(c) for c in CLASS_COLUMNS if c not in KEY + ["content_hash", "model"]])


def current_classifications(classifications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Only classifications of each job's current content."""
    return classifications.join(jobs.select(*KEY, "content_hash", "company", "title", "url",
                                            F.col("location").alias("job_location")),
                                KEY + ["content_hash"], "inner")
