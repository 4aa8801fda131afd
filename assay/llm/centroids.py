"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors are turned into integers once and written. In each round a task takes its vectors in
blocks; for every dimension it tabulates, for each integer that occurs there and each centroid,
the squared difference. A vector's distances are then gathered from these tables and added up.
A task sends one row per centroid, with counts and sums; Spark adds them, and the driver holds
nothing but the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

_LONG_MAX = 2**63 - 1
_BLOCK = 1 << 14


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and x, the components floor(scale * value), of vectors with ``dims`` finite components.

    Integers beyond +-isqrt(2^60 / dims) count as that, so that squared distances fit a long.
    """
    most = isqrt(2**60 // dims)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * float(scale)), F.lit(-most)), F.lit(most)).cast("int"))
    return vectors.where((F.size("embedding") == dims) & finite).select("vec_id", whole.alias("x"))


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers that occur, ascending, and the place of each row's among them."""
    low, span = int(column.min()), int(column.max()) - int(column.min()) + 1
    if span > 4 * len(column):
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the first of equals) and the squared distance to it, for each row."""
    distance = np.zeros((len(x), len(centroids)), np.int64)
    for column, at in zip(x.T, centroids.T):
        values, place = occurring(column)
        distance += ((values[:, None] - at[None, :]) ** 2)[place]
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(x)), cluster]


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, _BLOCK):
        part = batch.slice(at, _BLOCK)
        yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, x in _blocks(batch, centroids.shape[1]):
                cluster, _ = nearest(x, centroids)
                order = np.argsort(cluster, kind="stable")
                ids, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
                sums[ids] += np.add.reduceat(x[order], first)
                count[ids] += n
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    return rows


def _assigned(centroids: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, centroids.shape[1]):
                cluster, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty centroid becomes floor(sum / count) of its vectors, exactly; empty ones stay."""
    sums = rows.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    sums = sums.select("cluster", "n", F.posexplode("sums").alias("pos", "part"))
    sums = sums.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # one row per centroid and dimension
        out[r.cluster, r.pos] = int(r.total) // r.n
    return out


def centroid_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Lloyd's rounds over integer vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors (column ``embedding``) with exactly ``dims`` components, none null or not finite, are
    kept; the others, and null ones, give no row. Components become floor(scale * value). The first
    centroids are the kept vectors with the smallest sha256 of ``seed:vec_id``, in that order; of
    equal ids, and null ones, which count as empty text, the lesser vector comes first. With fewer vectors there are
    fewer centroids. Distances are squared Euclidean; ties go to the smaller number. After the
    rounds vectors are assigned once more. Inertia is the sum of distances, at most 2^63 - 1. Repeated rows are vectors
    of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dims, scale), "centroid-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(order, "x").limit(clusters).collect()  # ``clusters`` rows
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if first else 0):
        centroids = next_centroids(rows, centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialize(rows.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"), "centroid-assigned")
    parts = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # one row per centroid
    total = min(sum(int(r.total) for r in parts), _LONG_MAX)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    named = [(r.cluster, min(int(r.total), _LONG_MAX), total, digest(r.cluster)) for r in parts]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
