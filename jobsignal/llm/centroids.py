"""Operator 13: centroid clustering over subvector dictionaries.

Vectors are turned into integers once and stored in chunks.  A chunk cuts its
vectors into blocks of ``WIDTH`` dimensions and keeps, for every block, the
distinct subvectors (its dictionary) and one code per vector, from which every
vector can be restored.  A round computes the exact squared distance of each
dictionary entry to each centroid's block once, and a vector's distance is the sum
of the entries its codes name.  The sums of new centroids come from the
dictionaries too: each entry times its number of vectors in the cluster.  Only the
centroids go to the workers, and only one row per centroid comes back.

Defined cases: vectors that are null, hold null or non-finite components or have
another number of components are not kept; a null vec_id is hashed as the empty
string and its vectors take part; rows of the same vec_id are each a vector (as
starting centroids they go by their components); fewer kept vectors than ``K``
make fewer centroids; a centroid without vectors stays; no kept vector, no rows;
integers beyond +-``LARGEST`` are taken as +-``LARGEST``, so that every distance is
exact in 64 bits; sums of distances beyond 64 bits are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsignal.llm.common import Tables

DIMS = 64
K = 16
ROUNDS = 3
SCALE = 64
#: Dimensions of a block: few enough that its subvectors repeat.
WIDTH = 2
#: Vectors of a chunk, at most (chunks don't cross Arrow batches).
CHUNK = 16_384
LARGEST = 1 << 27


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of whole numbers."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(e, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return vectors.where(e.isNotNull() & (F.size(e) == dims) & ~bad).select("vec_id", whole.alias("v"))


def encode(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, code of every vector) of each block of ``WIDTH`` dimensions; lossless."""
    out = []
    for a in range(0, v.shape[1], WIDTH):
        block = np.ascontiguousarray(v[:, a:a + WIDTH])
        low = block.min(0)
        key = np.zeros(len(block), np.int64)  # one integer per subvector: 2 * LARGEST fits twice in 62 bits
        for d in range(block.shape[1]):
            key = key * (int(block[:, d].max() - low[d]) + 1) + (block[:, d] - low[d])
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        out.append((block[first], code.astype(np.int32)))
    return out


def decode(blocks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([entries[code] for entries, code in blocks], axis=1)


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every vector of a chunk; the smaller number wins ties."""
    total = np.zeros((len(blocks[0][1]), len(centroids)), np.int64)
    a = 0
    for entries, code in blocks:
        part = ((entries[:, None, :] - centroids[None, :, a:a + entries.shape[1]]) ** 2).sum(2)
        total += part[code]
        a += entries.shape[1]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(total)), cluster]


def cluster_sums(blocks: list[tuple[np.ndarray, np.ndarray]], cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors, from the number of vectors per cluster and dictionary entry."""
    out = []
    for entries, code in blocks:
        times = np.bincount(cluster * len(entries) + code, minlength=k * len(entries)).reshape(k, len(entries))
        out.append(times @ entries)
    return np.concatenate(out, axis=1)


def pack(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    return [{"entries": e.astype("<i8").tobytes(), "codes": c.astype("<i4").tobytes()} for e, c in blocks]


def unpack(stored: list[dict], dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    widths = [min(WIDTH, dims - a) for a in range(0, dims, WIDTH)]
    return [(np.frombuffer(s["entries"], "<i8").reshape(-1, w), np.frombuffer(s["codes"], "<i4")) for s, w in zip(stored, widths)]


def chunks(whole: DataFrame, dims: int = DIMS) -> DataFrame:
    """One row per chunk: the ids of its vectors and each block's dictionary and codes."""
    vec_id = whole.schema["vec_id"].dataType
    stored = T.ArrayType(T.StructType([T.StructField("entries", T.BinaryType()), T.StructField("codes", T.BinaryType())]))
    schema = T.StructType([T.StructField("ids", T.ArrayType(vec_id)), T.StructField("blocks", stored)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                ids = part.column("vec_id")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                                                  pa.array([pack(encode(v))], pa.list_(pa.struct([("entries", pa.binary()), ("codes", pa.binary())])))],
                                                 names=["ids", "blocks"])

    return whole.mapInArrow(run, schema)


def start(whole: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors of the smallest hashes, in the order of these (k rows reach the driver)."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = whole.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: (r["h"], r["v"]))], np.int64)


def moved(chunked: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of the vectors nearest to each centroid; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for stored in batch.column("blocks"):
                blocks = unpack(stored.as_py(), dims)
                cluster, _ = nearest(blocks, centroids)
                sums += cluster_sums(blocks, cluster, k)
                n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    parts = chunked.select("blocks").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
                                         *(F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims))).collect()
    out = centroids.copy()
    for r in total:
        out[r["cluster"]] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(dims)]
    return out


def assigned(chunked: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    schema = T.StructType([T.StructField("vec_id", chunked.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, stored in zip(batch.column("ids"), batch.column("blocks")):
                cluster, distance = nearest(unpack(stored.as_py(), dims), centroids)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return chunked.mapInArrow(run, schema)


def cluster(spark: SparkSession, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    tables = Tables(spark, "centroids")
    whole = integers(vectors, dims)
    centroids = start(whole, k)
    if not len(centroids):
        return assigned(chunks(whole, dims), np.zeros((1, dims), np.int64)).select(
            "*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    chunked = tables.save(chunks(whole, dims))
    for _ in range(rounds):
        centroids = moved(chunked, centroids)
    rows = tables.save(assigned(chunked, centroids))
    tables.drop(chunked)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    facts = [(c, long(s), long(sum(sums.values())), sha[c]) for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
