"""Centroid clustering of integer vectors by ball k-means.

A cluster is a ball: its centroid and the greatest distance of a member. Two
clusters are neighbours where the gap between their centroids is no more than
twice the radius; no member of one can be nearer to the centroid of a cluster
that is no neighbour. Members nearer to their own centroid than half the gap
to the nearest neighbour are the stable core and stay without a comparison.
The rest lie in annuli, bounded by half the gaps in ascending order: a member
of the i-th annulus is compared with the i nearest neighbours, exactly, in
integers.

A round is one pass over the staged vectors: every batch holds the part of
each ball that it read, moves members, and adds the sums of the clusters it
made, one row a cluster; Spark adds these up, so the driver sees centroids
only (`k` rows of `dims` integers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import discard, staged

#: Components are integers below this in size, so that squared distances fit 64 bits.
WIDEST = 1 << 27
_KIND = "vec_id long, v binary, cluster int, distance long, n long, sums array<long>"


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the components floor(scale * x), of vectors with exactly `dims` finite components."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < WIDEST / scale))
    kind = T.LongType()
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast(kind)).alias("x"))


def _packed(rows: DataFrame) -> DataFrame:
    """v as bytes of 32-bit integers, all in cluster 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy().astype("<i4")
            yield _table(batch.column("vec_id"), flat.reshape(len(batch), -1) if len(batch) else flat.reshape(0, 1), np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64))

    return rows.mapInArrow(run, _KIND)


def _table(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of vectors and, after them, a row of sums for each cluster of the batch."""
    n, width = x.shape[0], x.shape[1] * 4
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    v = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x, "<i4").tobytes())])
    which, many, total = sums if sums else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.int64))
    extra = len(which)

    def column(main: pa.Array, rest: pa.Array) -> pa.Array:
        return pa.concat_arrays([main, rest])

    lists = pa.ListArray.from_arrays(pa.array(np.arange(extra + 1, dtype=np.int32) * total.shape[1]), pa.array(total.reshape(-1))) if extra else pa.nulls(0, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            column(ids, pa.nulls(extra, pa.int64())), column(v, pa.nulls(extra, pa.binary())), pa.array(np.concatenate([cluster, which]).astype(np.int32)),
            column(pa.array(distance), pa.nulls(extra, pa.int64())), column(pa.nulls(n, pa.int64()), pa.array(many)), column(pa.nulls(n, pa.list_(pa.int64())), lists),
        ],
        names=["vec_id", "v", "cluster", "distance", "n", "sums"],
    )


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in 64-bit integers."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Gaps:
    """For each centroid the others by ascending distance, with four times their bounds."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        self.near, self.gap = [], []
        for i in range(k):
            other = np.delete(np.arange(k), i)
            gap = squared(centroids[other], centroids[i])
            order = np.lexsort((other, gap))
            self.near.append(other[order])
            self.gap.append(gap[order])

    def move(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, distance) of the nearest centroid, from the clusters that rows were in; and the exact comparisons made."""
        best, least, compared = cluster.copy(), np.zeros(len(x), np.int64), len(x)
        for i in np.unique(cluster):
            of = np.flatnonzero(cluster == i)
            own = squared(x[of], self.centroids[i])
            best[of], least[of] = i, own
            # Half a gap is crossed where gap**2 <= 4 * own**2; beyond the radius no gap is.
            reach = int(np.searchsorted(self.gap[i], 4 * int(own.max()), "right"))
            annulus = np.searchsorted(self.gap[i][:reach], 4 * own, "right")
            for place in range(reach):
                at = np.flatnonzero(annulus > place)
                j = int(self.near[i][place])
                d = squared(x[of[at]], self.centroids[j])
                compared += len(at)
                better = (d < least[of[at]]) | (d == least[of[at]]) & (j < best[of[at]])
                rows = of[at[better]]
                best[rows], least[rows] = j, d[better]
        return best, least, compared


def _round(centroids: np.ndarray, sums: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = Gaps(centroids)
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(batch.column("v").cast(pa.large_binary()).buffers()[2], "<i4", len(batch) * centroids.shape[1], _first(batch.column("v"))).reshape(len(batch), -1)
            cluster, distance, _ = gaps.move(x, batch.column("cluster").to_numpy())
            made = None
            if sums:
                which = np.unique(cluster)
                total = np.stack([x[cluster == i].sum(axis=0, dtype=np.int64) for i in which])
                made = which.astype(np.int32), np.array([(cluster == i).sum() for i in which], np.int64), total
            yield _table(batch.column("vec_id"), x, cluster, distance, made)

    return run


def _first(column: pa.Array) -> int:
    """Byte where the values of a binary column begin."""
    column = column.cast(pa.large_binary())
    return int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])


def ball_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """Clusters of vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors needs vec_id and embedding; other columns are ignored. Vectors
    with exactly `dims` components, none null or non-finite, take part as
    integers floor(scale * x). Centroids start as the k vectors with the
    least SHA-256 of "seed:vec_id" (ties, as of repeated rows, by components;
    rows without vec_id last) and are numbered in that order. Each of `rounds`
    rounds moves every vector to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and replaces every centroid that
    has vectors by the floor of their mean; then vectors move once more.

    Components of 2**27 / scale or more in size would give squared distances
    beyond 64 bits; such vectors take no part. Equal centroids are kept: the
    smaller number takes all. With fewer than k vectors there are that many
    clusters; with none, no rows. What passes the driver is k * dims integers
    a round, whatever the input.
    """
    spark = vectors.sparkSession
    source = integer_vectors(vectors, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = source.select(F.col("vec_id").isNull().alias("last"), key.alias("key"), "x").orderBy("last", "key", "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in start], np.int64)
    now = staged(_packed(source), "vectors")
    for _ in range(rounds):
        before, now = now, staged(now.where("v is not null").mapInArrow(_round(centroids, True), _KIND), "moved")
        discard(before)
        for cluster, mean in _means(now.where("n is not null")):
            centroids[cluster] = mean
    before, now = now, staged(now.where("v is not null").mapInArrow(_round(centroids, False), _KIND).select("vec_id", "cluster", "distance"), "clusters")
    discard(before)
    inertia = {r.cluster: r.d for r in now.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return now.select(
        "vec_id", "cluster", "distance", _by_cluster([inertia.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), _by_cluster(digest).alias("centroid_sha256"),
    )


def _by_cluster(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)


def _means(partial: DataFrame) -> list[tuple[int, list[int]]]:
    """The floor of each cluster's mean; sums are added per cluster and component before they meet."""
    part = partial.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    mean = part.groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select("cluster", "i", F.expr("(s - pmod(s, n)) div n").alias("m"))
    by: dict[int, dict[int, int]] = {}
    for r in mean.collect():
        by.setdefault(r.cluster, {})[r.i] = r.m
    return [(c, [m[i] for i in range(len(m))]) for c, m in by.items()]
