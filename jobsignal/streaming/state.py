"""Stream state in hashed buckets, committed for all tables of a micro-batch at once.

A keyed table is dealt into ``buckets`` by a hash of its key.  A micro-batch reads and
rewrites only the buckets its keys touch, as ``<table>/v=<batch>/bucket=<k>``; an
appended table gets ``<table>/v=<batch>``.  Nothing written is visible before the
batch's manifest, one small JSON file put in place by a rename, names the current
version of every bucket.  Readers start from the newest manifest, so a crash between
two writes shows nothing, a replay of an unfinished batch overwrites what it left, and
a replay of a committed batch does nothing.  A manifest holds one number per bucket.

A keyed table may keep its wide columns apart (``<table>-apart/v=<batch>``): they are
written once, by the batch that brings them, and a row names that batch (``_held``), so
that a batch rewrites narrow rows only.  A commit deletes what neither its manifest nor
the one before it names.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
EMPTY = {"batch": -1, "keyed": {}, "appended": {}}
#: Texts are most of what a stream keeps.
CODEC = "zstd"
#: Rows kept apart per row of the table beyond which the table's own are written anew.
DEAD = 2


def in_spans(spans: list[list[int]]) -> list[int]:
    return [v for a, b in spans for v in range(a, b + 1)]


def longer(spans: list[list[int]], number: int) -> list[list[int]]:
    """The spans and one more number."""
    if spans and spans[-1][1] == number - 1:
        return [*spans[:-1], [spans[-1][0], number]]
    return [*spans, [number, number]]


class State:
    """Tables below ``root``; ``keys`` names the key columns of the keyed ones."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.keys[table]]), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[2:-5]) for n in names if n.startswith("b=") and n.endswith(".json"))

    def manifest(self, batch: int | None = None) -> dict:
        """The manifest of a batch, or the newest one."""
        known = self.manifests() if batch is None else [batch]
        if not known:
            return EMPTY
        rows = self.spark.read.text(f"{self.root}/manifest/b={known[-1]}.json", wholetext=True).collect()  # one file of bounded size
        return json.loads(rows[0][0])

    def begin(self, batch: int) -> Batch | None:
        """The open batch, or None if it is committed already."""
        known = self.manifests()
        if batch in known:
            return None
        below = [b for b in known if b < batch]
        return Batch(self, batch, self.manifest(below[-1]) if below else EMPTY)

    def read(self, table: str) -> DataFrame | None:
        """The table as of the newest manifest."""
        return self.at(self.manifest(), table)

    def at(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        rows = self.narrow(manifest, table, buckets)
        return rows if rows is None else self.whole(manifest, table, rows)

    def whole(self, manifest: dict, table: str, rows: DataFrame) -> DataFrame:
        """Rows of a table with the columns that it keeps apart, if any."""
        kept = manifest.get("apart", {}).get(table)
        if kept is None:
            return rows
        apart = self.apart(table, kept["spans"])
        return rows.join(apart, [c for c in apart.columns if c in rows.columns]).select(*kept["columns"])

    def apart(self, table: str, spans: list[list[int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{table}-apart/v={v}" for v in in_spans(spans)])

    def narrow(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table without the columns that it keeps apart."""
        if table in self.keys:
            now = manifest["keyed"].get(table, {})
            paths = [f"{self.root}/{table}/v={v}/bucket={k}" for k, v in now.items() if buckets is None or int(k) in buckets]
        else:
            paths = [f"{self.root}/{table}/v={v}" for v in in_spans(manifest["appended"].get(table, []))]
        return self.spark.read.parquet(*paths) if paths else None

    def vacuum(self) -> None:
        """Delete versions that the newest manifest no longer names (for when no reader holds an older one)."""
        self.sweep([self.manifest()])

    def sweep(self, live: list[dict]) -> None:
        """Delete versions of buckets, and of columns kept apart, that none of these manifests names; later batches' stay."""
        last = max(m["batch"] for m in live)
        for table in {t for m in live for t in m["keyed"]}:
            named = {(int(v), int(k)) for m in live for k, v in m["keyed"].get(table, {}).items()}
            for v, folder in self._versions(table):
                parts = [b.getPath() for b in self.fs.listStatus(folder) if b.getPath().getName().startswith("bucket=")]
                keep = [p for p in parts if v > last or (v, int(p.getName()[7:])) in named]
                for gone in [p for p in parts if p not in keep] if keep else [folder]:
                    self.fs.delete(gone, True)
            named = {v for m in live for v in in_spans(m.get("apart", {}).get(table, {}).get("spans", []))}
            for v, folder in self._versions(f"{table}-apart"):
                if v <= last and v not in named:
                    self.fs.delete(folder, True)

    def _versions(self, table: str) -> list[tuple]:
        """(number, folder) of the versions that a table has on disk."""
        folder = self._path(f"{self.root}/{table}")
        there = [s.getPath() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return [(int(p.getName()[2:]), p) for p in there if p.getName().startswith("v=")]


class Batch:
    """Writes of one micro-batch, visible together after ``commit``."""

    def __init__(self, state: State, number: int, before: dict):
        self.state, self.number, self.before = state, number, before
        self.keyed = {t: dict(v) for t, v in before["keyed"].items()}
        self.appended = {t: [list(x) for x in v] for t, v in before["appended"].items()}
        self.apart = dict(before.get("apart", {}))
        self.staged: list[str] = []
        self.written: list[str] = []

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.state.bucket(table)).distinct().collect())

    def read(self, table: str, buckets: list[int]) -> DataFrame | None:
        return self.state.at(self.before, table, buckets)

    def narrow(self, table: str, buckets: list[int]) -> DataFrame | None:
        """:meth:`read` without the columns that the table keeps apart; :meth:`whole` adds them to some of its rows."""
        return self.state.narrow(self.before, table, buckets)

    def whole(self, table: str, rows: DataFrame) -> DataFrame:
        return self.state.whole(self.before, table, rows)

    def _folder(self, table: str) -> str:
        path = f"{self.state.root}/{table}/v={self.number}"
        self.written.append(path)
        return path

    def write(self, table: str, rows: DataFrame, buckets: list[int]) -> None:
        """The new contents of the touched buckets."""
        rows.select("*", self.state.bucket(table)).repartition("bucket").write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(self._folder(table))
        now = self.keyed.setdefault(table, {})
        there = {s.getPath().getName() for s in self.state.fs.listStatus(self.state._path(self.written[-1]))}
        for k in buckets:
            if f"bucket={k}" in there:
                now[str(k)] = self.number
            else:
                now.pop(str(k), None)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", CODEC).parquet(self._folder(table))
        self.appended[table] = longer(self.appended.get(table, []), self.number)

    def mostly_dead(self, table: str) -> bool:
        """More than ``DEAD`` rows are kept apart per row of the table (counts by file footers)."""
        kept = self.apart.get(table)
        if kept is None:
            return False
        now = self.narrow(table, list(range(self.state.buckets)))
        return self.state.apart(table, kept["spans"]).count() > DEAD * (now.count() if now is not None else 0)

    def write_apart(self, table: str, rows: DataFrame, columns: list[str], anew: bool = False) -> None:
        """Wide columns of rows that this batch writes, with their key; ``anew``: of all of the table's rows.  The whole table has ``columns``."""
        rows.withColumn("_held", F.lit(self.number).cast("long")).write.mode("overwrite").option("compression", CODEC).parquet(self._folder(f"{table}-apart"))
        before = [] if anew or table not in self.apart else self.apart[table]["spans"]
        self.apart[table] = {"spans": longer(before, self.number), "columns": columns}

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that several writes of this batch read; gone after the commit."""
        path = f"{self.state.root}/stage-{name}/v={self.number}"
        self.staged.append(path)
        rows.write.mode("overwrite").option("compression", CODEC).parquet(path)
        return self.state.spark.read.schema(rows.schema).parquet(path)

    def unstage(self, name: str) -> None:
        """Staged rows that no later write of this batch reads."""
        path = f"{self.state.root}/stage-{name}/v={self.number}"
        self.staged.remove(path)
        self._delete([path])

    def _delete(self, paths: list[str]) -> None:
        for p in paths:
            self.state.fs.delete(self.state._path(p), True)

    def commit(self) -> None:
        manifest = {"batch": self.number, "keyed": self.keyed, "appended": self.appended, "apart": self.apart}
        body = json.dumps(manifest, sort_keys=True)
        target = f"{self.state.root}/manifest/b={self.number}.json"
        part = self.state._path(f"{self.state.root}/manifest/.b={self.number}.part")
        out = self.state.fs.create(part, True)
        out.write(bytearray(body.encode()))
        out.close()
        if not self.state.fs.rename(part, self.state._path(target)):
            raise RuntimeError(f"manifest {target} could not be put in place")
        self._delete(self.staged)
        self.state.sweep([self.before, manifest])

    def abandon(self) -> Batch:
        """Remove what this batch wrote and start it anew from the tables before it."""
        self._delete(self.written + self.staged)
        return Batch(self.state, self.number, self.before)


def union(parts: list[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])
