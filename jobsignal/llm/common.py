"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)

#: Characters or bytes of text that one step inside a task works on.
BLOCK = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests) gets a scratch folder;
    on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="run-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def workers_import(spark: SparkSession) -> None:
    """Let local Python workers import this package wherever the session was started (on a cluster it is installed or shipped)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


class Tables:
    """Tables written in the shared folder to cut lineage; ``drop`` removes what only finished steps read."""

    def __init__(self, spark: SparkSession, name: str):
        workers_import(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose texts hold about ``limit`` bytes (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(group)]):
        if b > a:
            yield batch.slice(int(a), int(b - a))
    release()


def release() -> None:
    """Give freed memory back to the system: workers are kept from job to job, and glibc keeps what they have freed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (so that their order is like random)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connected_components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by the edges (a, b).

    Each round gives every node the smallest label among its neighbours and then
    follows that label once, so chains shrink by doubling.  Labels stay in a
    written table; the driver sees one count per round.  Loops, repeated edges
    and edges with a null end are harmless.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = tables.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = tables.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("component")))
    while True:
        near = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("m")))
        step = (label.join(near, "node", "left")
                .select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = tables.save(step.join(jump, "component", "left")
                          .select("node", "old", F.least("component", "further").alias("component")))
        changed = new.where("old <> component").limit(1).count()
        tables.drop(label)
        label = new
        if not changed:
            tables.drop(both)
            return label.select("node", "component")
