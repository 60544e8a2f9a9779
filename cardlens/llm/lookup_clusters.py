"""Centroid clustering with scalar lookup tables (operator 12).

Vectors become integers once and are written.  A round is one pass over them: a
task tabulates, for each dimension, the squared difference of each integer that
occurs in its batch to each centroid; a vector's distances are then gathers from
these tables and their sums, in exact integers.  Tasks hand on one row for each
cluster they met, its count and component sums, which are added up as decimals;
the next centroids, ``clusters`` times ``dims`` numbers whatever the input, are
made from those by exact floor division and travel with the next round's tasks.

No vector passes through the driver but the ``clusters`` first ones, nothing is
shuffled but the partial sums, and a vector that is there a million times is as
many rows of many tasks.  A lost executor repeats its batches of one round.

Vectors that are null, have another number of components, or hold a null or a
number that is not finite are left out.  A component whose integer is beyond
``LARGEST`` is refused, since distances would not fit in a long.  Fewer vectors
than ``clusters`` give as many centroids; an empty table gives no rows.
Repeated rows count as often as they are there; a null id is an empty one in the
first order, whose ties go by the components.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small, frugal

LARGEST = 1 << 27
PARTIAL = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


def integers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, point) of the vectors that are kept: ``floor(scale * x)`` of each component."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            # ragged or null rows: the flat values of the others alone
            right = (lengths == dims) & ~np.asarray(lists.is_null())
            flat = lists.filter(pa.array(right)).flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            fine = np.isfinite(x).all(1)
            x = np.floor(x[fine] * scale)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component of {col} is beyond {LARGEST} / {scale}: squared distances would not fit in a long")
            ids = batch.column(0).filter(pa.array(right)).filter(pa.array(fine))
            offsets = pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32).ravel()))], names=["vec_id", "point"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{col}`").cast("array<double>").alias("x"))
    return rows.mapInArrow(frugal(run), "vec_id long, point array<int>")


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids) exact squared distances by table lookups."""
    n, dims = points.shape
    low, high = points.min(0).astype(np.int64), points.max(0).astype(np.int64)
    widest = np.maximum(np.abs(high[:, None] - centroids.T), np.abs(low[:, None] - centroids.T)).max(1)
    small = int((widest.astype(object) ** 2).sum()) < 1 << 31
    kind = np.int32 if small else np.int64
    total = np.zeros((n, len(centroids)), kind)
    part = np.empty_like(total)
    for j in range(dims):
        column = points[:, j] - low[j]
        if high[j] - low[j] <= 4 * n + 1024:  # number the integers that occur
            seen = np.zeros(high[j] - low[j] + 1, bool)
            seen[column] = True
            values, place = np.flatnonzero(seen), np.cumsum(seen)[column] - 1
        else:
            values, place = np.unique(column, return_inverse=True)
        table = ((values + low[j])[:, None] - centroids[None, :, j]) ** 2
        np.take(table.astype(kind), place, axis=0, out=part, mode="clip")
        total += part
    return total


def _points(batch, dims: int, at: int = 1) -> np.ndarray:
    return batch.column(at).flatten().to_numpy().reshape(-1, dims)


def _sums(points: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, component sums)} of the nearest centroids."""
    k, dims = centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _points(batch, dims, 0)
                near = squared_distances(x, centroids).argmin(1)
                n += np.bincount(near, minlength=k)
                one = np.zeros((k, len(x)))
                one[near, np.arange(len(x))] = 1
                sums += (one @ x.astype(np.float64)).astype(np.int64)  # whole numbers below 2**53: exact
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    parts = points.select("point").mapInArrow(frugal(run), PARTIAL)
    by_place = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in by_place.collect():  # clusters * dims rows
        totals.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["place"]] = int(r["s"])
    return totals


def first_centroids(points: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The ``clusters`` vectors with the smallest hashes of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select(order.alias("h"), "point").orderBy("h", "point").limit(clusters).collect()
    return np.array([r["point"] for r in rows], np.int64)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", dims: int = 64, clusters: int = 40,
                      rounds: int = 5, scale: int = 256, seed: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept."""
    tables = Tables(vectors.sparkSession, "lookup-clusters")
    points = tables.write(integers(vectors, id_col, col, dims, scale), "points")
    centroids = first_centroids(points, clusters, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, sums) in _sums(points, centroids).items():
            centroids[cluster] = [s // n for s in sums]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                far = squared_distances(_points(batch, dims), centroids)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)),
                                                  pa.array(far[np.arange(len(near)), near].astype(np.int64))], names=["vec_id", "cluster", "distance"])

    assigned = tables.write(points.mapInArrow(frugal(run), ASSIGNED), "assigned")
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a cluster
    facts = vectors.sparkSession.createDataFrame(
        [(i, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, d in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(broadcast_if_small(facts, 128 * len(centroids)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
