"""Operator 10: embedding near-dedup with a forest of random-projection trees.

Equal vectors form one class.  Every tree splits the classes again and again: a
node draws a random direction, takes the median of the projections of a bounded
sample of its members, and sends members left or right; those within ``SPILL`` of
the median (as a share of the sample) go both ways.  Nodes are split in rounds,
``LEVELS`` levels at a time, while any holds more than ``LEAF`` members; samples
are fitted, and members routed, by Spark tasks.  A split is judged by the linked pairs
of its sample: of up to ``TRIES`` directions the first is taken that parts at most
``PARTED`` of them.  A node that every direction would part (a large group of near
copies, tight or loose) is not split: its members are dealt into blocks of about
``LEAF``, and all pairs of blocks are compared, each by its own task.  Inside a leaf all
members are compared exactly in double precision, and the links of all trees are united.
Links are never wrong; some can be missed where every tree parts a pair.

Defined cases: null, empty, zero vectors and vectors with null or non-finite
components link with nothing and are kept; vectors of different lengths are not
compared; repeated rows of one vec_id and vector are one vector (each row gets
its result); equal vectors under other ids are linked; rows without an id give
component null and are not kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.llm.common import Tables, connected_components

TREES = 6
#: Members beyond which a node is split again.
LEAF = 1000
#: Members of a node that its splits are fitted on, at most about.
SAMPLE = 2000
#: Levels fitted in one round (a node's subtree is 2 ** LEVELS - 1 pairs of bounds).
LEVELS = 4
SPILL = 0.06
#: A split may part this share of its sample's linked pairs, taken from so many members; fewer than ``JUDGED`` linked pairs tell nothing.
PARTED = 0.05
PAIRED = 700
JUDGED = 12
#: Directions that a node tries.
TRIES = 12


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _direction(tree: int, leaf: int, node: int, attempt: int, dim: int) -> np.ndarray:
    return np.random.default_rng([tree, leaf % (1 << 62), node, attempt]).normal(size=dim)


def linked_pairs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the linked pairs among some members of a sample."""
    some = np.arange(0, len(x), -(-len(x) // PAIRED))
    a, b = np.nonzero(np.triu(x[some] @ x[some].T >= threshold, 1))
    return some[a], some[b]


def fit_subtree(x: np.ndarray, tree: int, leaf: int, total: int, threshold: float, most: int) -> np.ndarray:
    """(low, high, blocks, attempt) of each node, in heap order.

    Nodes of at most about ``most`` members don't split (low above high); those that
    every direction would part don't either, and ``blocks`` is the number of blocks
    their members are dealt into.
    """
    bounds = np.tile([np.inf, -np.inf, 0, 0], ((1 << LEVELS) - 1, 1))
    inside = {0: np.arange(len(x))}
    for node in range(len(bounds)):
        rows = inside.pop(node, np.zeros(0, np.int64))
        if len(rows) < 8 or len(rows) * total <= most * len(x):
            continue
        a, b = linked_pairs(x[rows], threshold)
        for attempt in range(TRIES):
            at = x[rows] @ _direction(tree, leaf, node, attempt, x.shape[1])
            low, high = np.quantile(at, [0.5 - SPILL, 0.5 + SPILL])
            left, right = at < low, at > high
            if len(a) < JUDGED or ((left[a] & right[b]) | (right[a] & left[b])).mean() <= PARTED:
                bounds[node] = low, high, 0, attempt
                inside[2 * node + 1], inside[2 * node + 2] = rows[~right], rows[~left]
                break
        else:
            bounds[node, 2] = -(-len(rows) * total // (most * len(x)))
    return bounds


def route(x: np.ndarray, tree: int, leaf: int, bounds: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """(rows, new leaf, blocks) for each leaf of the subtree; blocks is 0 unless the leaf is dense."""
    out, open_ = [], [(0, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        low, high, blocks, attempt = bounds[node] if node < len(bounds) else (np.inf, -np.inf, 0, 0)
        if low > high:
            out.append((rows, leaf * (2 << LEVELS) + node + 1, int(blocks)))
            continue
        at = x[rows] @ _direction(tree, leaf, node, int(attempt), x.shape[1])
        open_ += [(2 * node + 1, rows[at <= high]), (2 * node + 2, rows[at >= low])]
    return [o for o in out if len(o[0])]


def forest(tables: Tables, vectors: DataFrame, threshold: float) -> DataFrame:
    """(tree, dim, leaf, node, raw, blocks) rows, in which only unsplit groups (blocks above 0) hold more than ``LEAF`` members."""
    schema = "tree int, dim int, leaf long, node long, raw binary, blocks int"
    most = LEAF
    open_ = vectors.select(F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("tree"), "dim", F.lit(1).cast("long").alias("leaf"), "node", "raw", F.lit(0).alias("blocks"))
    done: list[DataFrame] = []

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, dim, leaf = (int(k) for k in key)
        bounds = fit_subtree(_matrix(pdf.raw.tolist(), dim), tree, leaf, int(pdf.n.iloc[0]), threshold, most)
        return pd.DataFrame({"tree": [tree], "dim": [dim], "leaf": [leaf], "bounds": [bounds.tobytes()]})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for (tree, dim, leaf), g in pdf.groupby(["tree", "dim", "leaf"], sort=False):
                raw, node = g.raw.to_numpy(), g.node.to_numpy()
                bounds = np.frombuffer(g.bounds.iloc[0], np.float64).reshape(-1, 4)
                for rows, new, blocks in route(_matrix(raw.tolist(), dim), tree, leaf, bounds):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree), pa.int32()), pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, new), pa.int64()),
                                                      pa.array(node[rows], pa.int64()), pa.array(raw[rows].tolist(), pa.binary()), pa.array(np.full(n, blocks), pa.int32())],
                                                     names=["tree", "dim", "leaf", "node", "raw", "blocks"])

    key = ["tree", "dim", "leaf"]
    while True:
        large = open_.where("blocks = 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF)
        if not large.limit(1).count():
            break
        done.append(open_.join(large, key, "left_anti"))
        part = open_.join(large, key)
        taught = part.where(F.pmod(F.xxhash64("node", "tree", "leaf"), F.col("n")) < SAMPLE)
        bounds = taught.groupBy(*key).applyInPandas(fit, "tree int, dim int, leaf long, bounds binary")
        open_ = tables.save(part.select(*key, "node", "raw").join(bounds, key).mapInArrow(send, schema))
    for d in done:
        open_ = open_.union(d)
    return open_


def links(leaves: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of leaf members whose cosine reaches the threshold.

    An unsplit group is compared per pair of its blocks (p <= q): every member goes to all pairs that hold its block.
    """
    at = F.pmod(F.xxhash64("node", "leaf"), F.greatest("blocks", F.lit(1))).cast("int")
    pairs = leaves.withColumn("own", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1)))
    pairs = pairs.select("tree", "dim", "leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "raw")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf.node.to_numpy()
        x = _matrix(pdf.raw.tolist(), int(pdf.dim.iloc[0]))
        p, q = int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
        first = np.flatnonzero(pdf.own.to_numpy() == p)
        second = first if p == q else np.flatnonzero(pdf.own.to_numpy() == q)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(first), 512):
            start = i if p == q else 0
            r, c = np.nonzero(x[first[i:i + 512]] @ x[second[start:]].T >= threshold)
            if p == q:
                r, c = r[c > r], c[c > r]
            left.append(node[first[i + r]])
            right.append(node[second[start + c]])
        a, b = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return pairs.groupBy("tree", "dim", "leaf", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept."""
    tables = Tables(spark, "vectors")
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    # a class is a distinct vector; its node is a number drawn from the vector, its name the smallest id
    good = rows.where("v is not null").withColumn("node", F.xxhash64("v"))
    classes = tables.save(good.where("vec_id is not null").distinct().groupBy("node", "v").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            flat, off = col.values.to_numpy(), col.offsets.to_numpy()
            raw = [flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int32()), pa.array(raw, pa.binary())], names=["node", "dim", "raw"])

    vectors = tables.save(classes.select(F.col("name").alias("node"), "v").mapInArrow(pack, "node long, dim int, raw binary"))
    found = tables.save(links(forest(tables, vectors, threshold), threshold))
    size = classes.groupBy("name").agg(F.sum("copies").alias("copies"))
    ends = found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(size.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.sum("copies").alias("others"))
    nodes = connected_components(tables, found)
    named = (classes.join(degree, "name", "left").join(nodes.withColumnRenamed("node", "name"), "name", "left")
             .select("node", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "name").alias("component")))
    out = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).join(named, ["node", "v"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
                      F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
