"""Structured Streaming drivers (R2-R7, R9): micro-batches over landed files.

Each stateful stream keeps its state in hashed buckets in the shared state
folder (``spark.checkpoint.dir``, :mod:`jobsignal.streaming.state`): micro-batch
``b`` reads the buckets its keys touch, applies the batch with the same DataFrame
operators as the batch path, writes version ``b`` of these buckets and commits them
by a manifest.  A replayed batch is a no-op or overwrites its unfinished writes, the
written tables cut lineage, and an executor loss only re-runs tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.operators import alerts as A
from jobsignal.operators import health as H
from jobsignal.operators import store as S
from jobsignal.session import state_root
from jobsignal.streaming import ingest as I
from jobsignal.streaming.state import CODEC, State

#: Spark deletes a statement's shuffle files when it ends; without it they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of finished statements go at once (each reads written tables only)."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def land_slices(df: DataFrame, landing: str, ts: str, cuts: list[int]) -> None:
    """Write ``df`` as time-ordered slices, one folder each, with as many files as tasks.

    Stands in for a poller landing files over time."""
    cuts = list(cuts)
    # one pass over ``df``: a row's slice is the number of cuts that it has reached
    reached = sum((F.when(F.col(ts) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.where(F.col(ts).isNotNull()) if cuts else df
    with freed(df.sparkSession):
        rows.withColumn("slice", F.format_string("%04d", reached)).write.mode("overwrite").option("compression", CODEC).partitionBy("slice").parquet(landing)
    fs, path = _fs(df.sparkSession, landing)
    there = {s.getPath().getName() for s in fs.listStatus(path)}
    for i in range(len(cuts) + 1):
        if f"slice={i:04d}" not in there:  # a slice without rows lands as well
            df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{landing}/slice={i:04d}")


def _run(spark: SparkSession, schema, landing: str, chk: str, fn, plan=lambda rows: rows, spent: bool = False) -> None:
    """``fn`` on the micro-batches of ``plan``, one per landed slice, in the slices' order: the file source lists what
    has landed up to a slice, skips what its checkpoint has already taken, and takes the
    rest of the slice's files together.  ``spent``: a slice is deleted once its micro-batch is committed (for
    a landing folder that the stream has to itself)."""
    fs, p = _fs(spark, landing)
    names = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().startswith("slice="))
    for k in range(len(names)):
        upto = "{" + ",".join(names[: k + 1]) + "}"
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{landing}/{upto}")
        with freed(spark):
            q = (plan(stream).writeStream.foreachBatch(fn).option("checkpointLocation", chk)
                 .trigger(availableNow=True).start())
            q.awaitTermination()
        if spent:
            fs.delete(_fs(spark, f"{landing}/{names[k]}")[1], True)


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{state_root(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


# --- R2/R9: job store -------------------------------------------------------------------


def job_upsert_stream(spark: SparkSession, versions: DataFrame, cuts: list[int], late: DataFrame | None = None,
                      root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply landed versions micro-batch by micro-batch; returns (jobs, late rows).

    Rows older than the key's recorded ``last_seen_ts`` are late: they are kept
    in the ``late`` table and do not change the job."""
    root = root or _scratch(spark, "jobs")
    landing = f"{root}/landing"
    land_slices(versions, landing, "observed_ts", cuts)
    if late is not None:
        late.write.mode("overwrite").parquet(f"{landing}/slice=9999")

    state = State(spark, root, {"jobs": S.KEY})

    def apply(batch: DataFrame, batch_id: int) -> None:
        if b := state.begin(batch_id):
            I.upsert_jobs(b, batch)
            b.commit()

    _run(spark, versions.schema, landing, f"{root}/chk", apply, spent=True)
    return state.read("jobs"), state.read("late")


# --- R1: landed responses to alerts ---------------------------------------------------------


def ingest_stream(spark: SparkSession, responses: DataFrame, cuts: list[int], root: str | None = None, **how) -> State:
    """Land the responses as slices cut at ``cuts`` and take them in (:mod:`jobsignal.streaming.ingest`)."""
    root = root or _scratch(spark, "ingest")
    land_slices(responses, f"{root}/landing", "fetched_ts", cuts)
    return I.ingest(spark, responses.schema, f"{root}/landing", root, partial(_run, spent=True), **how)


# --- R5/R6: board health ------------------------------------------------------------------


def merge_status(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Fold one micro-batch of poll outcomes into the per-board status table."""
    b = H.source_status(batch)
    if state is None:
        return b
    s = state.select(*[F.col(c).alias("s_" + c) if c not in H.BOARD else F.col(c) for c in state.columns])
    j = s.join(b, H.BOARD, "full")
    # a late batch row (older than the stored check) does not overwrite the newer status
    has_b = F.col("last_checked_ts").isNotNull() & (F.col("s_last_checked_ts").isNull() | (F.col("last_checked_ts") >= F.col("s_last_checked_ts")))

    def pick(c):
        return F.when(has_b, F.col(c)).otherwise(F.col("s_" + c)).alias(c)

    consec = (F.when(~has_b, F.col("s_consecutive_errors"))
              .when(F.col("last_ok_ts").isNotNull(), F.col("consecutive_errors"))
              .otherwise(F.coalesce(F.col("s_consecutive_errors"), F.lit(0)) + F.col("consecutive_errors")))
    return j.select(
        *H.BOARD, pick("status"), pick("detail"), pick("is_error"), pick("last_checked_ts"),
        F.greatest("last_ok_ts", "s_last_ok_ts").alias("last_ok_ts"),
        F.greatest("last_error_ts", "s_last_error_ts").alias("last_error_ts"),
        consec.cast("int").alias("consecutive_errors"),
    )


def events_with_state(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Change events of a micro-batch, the board's stored status acting as previous row."""
    if state is None:
        return H.change_events(batch)
    prev = state.select(F.lit(-1).cast("long").alias("seq"), *H.BOARD, "status", "detail",
                        F.lit(-(2 ** 62)).cast("long").alias("checked_ts"))
    both = prev.unionByName(batch.select("seq", *H.BOARD, "status", "detail", "checked_ts"))
    return H.change_events(both).where(F.col("seq") != -1)


def health_state(spark: SparkSession, log: DataFrame, cuts: list[int], root: str | None = None, keep: int = R.EVENT_RETENTION) -> State:
    """Tables ``status``, ``events`` (all changes) and ``retained`` (the newest ``keep`` of
    them, T8) maintained over micro-batches.  Newest by seq is a top-N of top-Ns, so any split into
    batches keeps the same events and a batch reads ``keep`` rows, not the log."""
    root = root or _scratch(spark, "health")
    landing = f"{root}/landing"
    land_slices(log, landing, "checked_ts", cuts)
    state = State(spark, root, {"status": H.BOARD, "retained": ["seq"]})
    every = list(range(state.buckets))

    def apply(batch: DataFrame, batch_id: int) -> None:
        if b := state.begin(batch_id):
            touched = b.touched("status", batch)
            before = b.read("status", touched)
            events = b.stage("new-events", events_with_state(before, batch))
            b.append("events", events)
            kept = b.read("retained", every)
            newest = H.newest(events, keep, F.desc("seq"))
            b.write("retained", newest if kept is None else H.newest(kept.select(*events.columns).unionByName(newest), keep, F.desc("seq")), every)
            b.write("status", merge_status(before, batch), touched)
            b.commit()

    _run(spark, log.schema, landing, f"{root}/chk", apply)
    return state


def health_stream(spark: SparkSession, log: DataFrame, cuts: list[int], root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Status table and change-event log after the whole stream."""
    state = health_state(spark, log, cuts, root)
    return state.read("status"), state.read("events")


# --- R7: cycle history with retention ---------------------------------------------------------


def newest_cycles(counts: DataFrame, keep: int) -> DataFrame:
    """The status counts of the newest ``keep`` cycles: a top-N of (cycle, service), so newer cycles alone decide who goes."""
    top = counts.select("service", "cycle_ts").distinct().orderBy(F.desc("cycle_ts"), F.desc("service")).limit(keep)
    return counts.join(F.broadcast(top), ["service", "cycle_ts"], "left_semi")


def cycle_history_stream(spark: SparkSession, log: DataFrame, cuts: list[int], late: DataFrame | None = None, root: str | None = None,
                         keep: int = R.CYCLE_RETENTION) -> DataFrame:
    """Status counts of the newest ``keep`` cycles, merged micro-batch by micro-batch.

    A batch adds its counts to the cycles that are kept, late polls included; a cycle
    that falls out is older than ``keep`` others for good, so any split into batches
    ends with the same history.  The state holds ``keep`` cycles and no more."""
    root = root or _scratch(spark, "cycles")
    land_slices(log, f"{root}/landing", "checked_ts", cuts)
    if late is not None:
        late.write.mode("overwrite").parquet(f"{root}/landing/slice=9999")
    state = State(spark, root, {"cycles": ["service"]}, buckets=1)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if b := state.begin(batch_id):
            cycle = (F.col("checked_ts") - F.col("checked_ts") % R.CYCLE_SECONDS).alias("cycle_ts")
            new = batch.groupBy("service", cycle, "status").agg(F.count(F.lit(1)).alias("n"), F.min("checked_ts").alias("lo"), F.max("checked_ts").alias("hi"))
            counts = newest_cycles(new, keep)  # partial top-N: no more than the state holds meets it
            if (old := b.read("cycles", [0])) is not None:
                counts = counts.unionByName(old).groupBy("service", "cycle_ts", "status").agg(
                    F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                counts = newest_cycles(counts, keep)
            b.write("cycles", counts, [0])
            b.commit()

    _run(spark, log.schema, f"{root}/landing", f"{root}/chk", apply)
    whole = Window.partitionBy("service", "cycle_ts")
    length = (F.max("hi").over(whole) - F.min("lo").over(whole)) * 1000
    return H.cycle_rollup(state.read("cycles").select("service", "cycle_ts", "status", "n", length.alias("duration_ms")))


# --- R4: alert once ----------------------------------------------------------------------------


def first_alerts_stream(spark: SparkSession, observations: DataFrame, cuts: list[int], root: str | None = None) -> DataFrame:
    """Notified set kept per micro-batch (first matching observation per id)."""
    root = root or _scratch(spark, "alerts")
    landing = f"{root}/landing"
    land_slices(observations, landing, "observed_ts", cuts)
    state = State(spark, root, {"notified": A.ID})

    def apply(batch: DataFrame, batch_id: int) -> None:
        if b := state.begin(batch_id):
            I.alert_once(b, A.deterministic_matches(batch))
            b.commit()

    _run(spark, observations.schema, landing, f"{root}/chk", apply)
    return state.read("notified")


# --- R3: classify only new/changed content ---------------------------------------------------------


def classify_stream(spark: SparkSession, versions: DataFrame, cuts: list[int], root: str | None = None,
                    rules: R.Rules = R.DEFAULT_RULES) -> DataFrame:
    """Inside the same micro-batch as the upsert, classify each (job, content hash)
    that this model has not classified (J2 anti join against the touched buckets of the classifications)."""
    root = root or _scratch(spark, "classify")
    landing = f"{root}/landing"
    land_slices(versions, landing, "observed_ts", cuts)
    state = State(spark, root, {"jobs": S.KEY, "classifications": S.KEY})

    def apply(batch: DataFrame, batch_id: int) -> None:
        if b := state.begin(batch_id):
            # raw save precedes classification
            touched = b.touched("jobs", batch)
            b.write("jobs", S.upsert(batch, b.read("jobs", touched)), touched)
            I.classify_new(b, batch, touched, rules)
            b.commit()

    _run(spark, versions.schema, landing, f"{root}/chk", apply, spent=True)
    return state.read("classifications")
