"""Exact integer k-means: distances by a matrix product in double precision where its sums stay below 2**53.

Vectors become integers, packed in blocks in a written table that every round reads. A round expands |x|**2 - 2 x.c + |c|**2 for
whole blocks; rows whose magnitude could leave the exact range go through integers instead. Sums meet by `treeAggregate`.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

#: Vectors of a block.
BLOCK = 2048
_EXACT, _LONG = 1 << 53, 1 << 63
_KINDS = {"i4": np.int32, "i8": np.int64}


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact, for a power of two: int64 where that holds it, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(y) or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", ",".join(map(str, x.ravel())).encode()
    kind = "i4" if not x.size or np.abs(x).max() < 1 << 31 else "i8"
    return kind, x.astype(_KINDS[kind]).tobytes()


def _unpacked(kind: str, body: bytes, size: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in body.decode().split(",")], object).reshape(-1, size)
    return np.frombuffer(body, _KINDS[kind]).reshape(-1, size)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smaller one of ties) and the squared distance, both exact.

    Distances are int64, or Python integers where some row needs them.
    """
    size, far = x.shape[1], max(abs(v) for c in centroids for v in c)
    top = np.abs(x.astype(object) if x.dtype == object else x.astype(np.int64)).max(axis=1)
    small = np.array([size * (int(t) + far) ** 2 < _EXACT for t in top]) if x.dtype == object or far >= 1 << 31 else size * (top.astype(np.float64) + far) ** 2 < _EXACT / 2
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if small.any():
        a, c = x[small].astype(np.float64), np.array(centroids, np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
        cluster[small] = d.argmin(axis=1)
        distance[small] = d.min(axis=1).astype(np.int64)
    if not small.all():
        rest = np.flatnonzero(~small)
        wide = x.dtype == object or size * (int(top.max()) + far) ** 2 >= _LONG
        kind = object if wide else np.int64
        d = np.stack([((x[rest].astype(kind) - np.array(c, kind)) ** 2).sum(axis=1) for c in centroids], axis=1)
        cluster[rest] = [min(range(len(row)), key=row.__getitem__) for row in d.tolist()]
        if wide:
            distance = distance.astype(object)
        distance[rest] = d[np.arange(len(rest)), cluster[rest]]
    return cluster, distance


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the sums of its components and its count, as Python integers."""
    out = np.zeros((k, x.shape[1] + 1), object)
    wide = x.dtype == object or int(np.abs(x.astype(np.int64)).max(initial=0)) * len(x) >= _LONG
    y = x.astype(object) if wide else x.astype(np.int64)
    for j in np.unique(cluster).tolist():
        own = y[cluster == j]
        out[j, :-1] = own.sum(axis=0).tolist()
        out[j, -1] = len(own)
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Kept are vectors of exactly `size` components, none null or non-finite, as integers floor(scale * x). The first centroids
    are the k kept vectors with the smallest sha256 of `seed:id`; rows that repeat an id, and so a hash, go by their components
    as text; rows with a null id are clustered but start no centroid. Fewer than k such vectors give as many clusters, none give
    an empty result. Each of `rounds` rounds assigns all vectors (ties to the smaller number) and moves every centroid with
    vectors to the exact floor of their mean. Distances and sums beyond 64 bits are null. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == size)

    def packed(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                part = part.filter(pc.equal(pc.list_value_length(part.column(1)), size))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                fine = np.isfinite(x).all(axis=1)
                if fine.any():
                    kind, body = _packed(scaled(x[fine], scale))
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).filter(pa.array(fine)).to_pylist()], pa.list_(pa.int64())), pa.array([kind]), pa.array([body], pa.binary())], names=["ids", "kind", "body"])

    blocks = Table(rows.mapInArrow(packed, "ids array<long>, kind string, body binary"), "blocks").df

    def lowest(batches):
        best: list[tuple[str, str]] = []
        for b in batches:
            for ids, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = _unpacked(kind, body, size)
                named = ((hashlib.sha256(f"{seed}:{v}".encode()).hexdigest(), i) for i, v in enumerate(ids) if v is not None)
                low = sorted(named)
                low = [y for y in low if y[0] <= low[min(k, len(low)) - 1][0]]
                best = heapq.nsmallest(k, best + [(h, ",".join(map(str, x[i]))) for h, i in low])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best]), pa.array([v for _, v in best])], names=["hash", "vector"])

    first = blocks.mapInArrow(lowest, "hash string, vector string").orderBy("hash", "vector").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[int(v) for v in r.vector.split(",")] for r in first]
    n = len(centroids)
    bodies = blocks.select("kind", "body").rdd

    def moved(own: list[list[int]]):
        def add(total, r):
            x = _unpacked(r.kind, bytes(r.body), size)
            return total + _sums(x, nearest(x, own)[0], n)

        return bodies.treeAggregate(np.zeros((n, size + 1), object), add, lambda a, b: a + b)

    for _ in range(rounds):
        sums = moved(centroids)
        centroids = [[s // row[-1] for s in row[:-1]] if row[-1] else old for old, row in zip(centroids, sums.tolist(), strict=True)]

    def spread(own: list[list[int]]):
        def add(total, r):
            cluster, distance = nearest(_unpacked(r.kind, bytes(r.body), size), own)
            total = total.copy()
            for j in np.unique(cluster).tolist():
                total[j] += sum(distance[cluster == j].tolist())
            return total

        return bodies.treeAggregate(np.zeros(n, object), add, lambda a, b: a + b)

    def fits(v: int):
        return v if v < _LONG else None

    inertia = spread(centroids).tolist()
    whole = fits(sum(inertia))
    own = pa.array([fits(v) for v in inertia], pa.int64())
    names = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])

    def assigned(batches):
        for b in batches:
            for ids, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cluster, distance = nearest(_unpacked(kind, body, size), centroids)
                at = pa.array(cluster)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array([fits(v) for v in distance.tolist()], pa.int64()), own.take(at), pa.array([whole] * len(ids), pa.int64()), names.take(at)],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(assigned, schema)
