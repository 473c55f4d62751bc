"""Clusters around integer centroids; each assignment is exact, by a table of pivot distances.

Distances from every vector to a few fixed pivots are computed once and stored beside it. In
every round the centroids' distances to the pivots are computed anew (a small matrix), and by the
triangle inequality the largest difference over the pivots is below the distance of a vector and
a centroid. The most promising centroid is tried first; one whose bound is beyond the best
distance found so far is never looked at, all others get exact integer distances. Tasks send
one row of sums for each cluster, whatever the number of vectors; vectors never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochord.session import written

#: Rows of one matrix step.
STEP = 4096


def largest_component(dim: int) -> int:
    """Integers up to this size have squared distances within 63 bits."""
    return int((2.0 ** 63 / dim) ** 0.5 / 2) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int
                    ) -> DataFrame:
    """(id, v: floor(scale * x) of each component x) of the usable rows."""
    vec, most = F.col(f"`{vec_col}`").cast("array<double>"), largest_component(dim) / scale
    usable = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)
                                             & (F.abs(x) <= most))
    return (vectors.filter(F.coalesce(usable, F.lit(False)))
            .select(F.col(f"`{id_col}`").alias("id"),
                    F.transform(vec, lambda x: F.floor(x * scale)).alias("v")))


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of these points, each the farthest from those before it."""
    chosen = [0]
    near = np.square(points - points[0]).sum(1)
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.square(points - points[chosen[-1]]).sum(1))
    return points[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[point, pivot]: distances in double precision, squares summed in integers."""
    return np.sqrt(np.stack([np.square(points - p).sum(1) for p in pivots], 1).astype(float))


def nearest(points: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray,
            pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances computed).

    Ties go to the smaller number. Bounds carry a margin for their rounding, so that no centroid
    that is as near as the best one is left out.
    """
    label, best, exact = (np.zeros(len(points), np.int64) for _ in range(3))
    mid = pivot_distances(centroids, pivots)
    for at in range(0, len(points), STEP):
        v, far = points[at:at + STEP], to_pivots[at:at + STEP]
        bound = np.abs(far[:, :1] - mid[:, 0])
        for p in range(1, len(pivots)):
            np.maximum(bound, np.abs(far[:, p:p + 1] - mid[:, p]), out=bound)
        bound -= 1e-9 * (1 + max(far.max(initial=0), mid.max(initial=0)))
        own = bound.argmin(1)
        d = np.square(v - centroids[own]).sum(1)
        root = np.sqrt(d.astype(float))
        exact[at:at + STEP] += 1
        for c in range(len(centroids)):
            rows = np.flatnonzero((bound[:, c] <= root) & (own != c))
            if not len(rows):
                continue
            new = np.square(v[rows] - centroids[c]).sum(1)
            exact[at + rows] += 1
            won = (new < d[rows]) | ((new == d[rows]) & (c < own[rows]))
            rows, new = rows[won], new[won]
            own[rows], d[rows], root[rows] = c, new, np.sqrt(new.astype(float))
        label[at:at + STEP], best[at:at + STEP] = own, d
    return label, best, int(exact.sum())


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
        pa.list_(pa.from_numpy_dtype(x.dtype)))


def _with_pivots(pivots: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), pivots.shape[1], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"),
                                              _lists(pivot_distances(v, pivots))],
                                             ["id", "v", "far"])
    return add


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, exact = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            v = _matrix(b.column("v"), dim, np.int64)
            label, _, n = nearest(v, _matrix(b.column("far"), len(pivots), float), centroids,
                                  pivots)
            order = np.argsort(label, kind="stable")
            met, first = np.unique(label[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(v[order], first, axis=0)
            counts += np.bincount(label, minlength=k)
            exact += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k)), pa.array(counts), pa.array(np.full(k, exact)),
             *[pa.array(sums[:, i].copy()) for i in range(dim)]],
            ["c", "n", "exact", *[f"s{i}" for i in range(dim)]])
    return add


def _assigned(centroids: np.ndarray, pivots: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, best, _ = nearest(_matrix(b.column("v"), centroids.shape[1], np.int64),
                                     _matrix(b.column("far"), len(pivots), float), centroids,
                                     pivots)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(label.astype(np.int32)), pa.array(best)],
                ["id", "cluster", "distance"])
    return add


def moved(points: DataFrame, centroids: np.ndarray, pivots: np.ndarray
          ) -> tuple[np.ndarray, int]:
    """Centroids after one round, and how many exact distances it took. The driver gets one row
    of sums for each centroid."""
    k, dim = centroids.shape
    names = ["n", *[f"s{i}" for i in range(dim)]]
    found = (points.mapInArrow(_sums(centroids, pivots), "c long, n long, exact long, "
                               + ", ".join(f"s{i} long" for i in range(dim)))
             .groupBy("c").agg(*[F.sum(x).alias(x) for x in names],
                               F.sum("exact").alias("exact")).collect())
    new, exact = centroids.copy(), 0
    for r in found:
        exact = r["exact"]
        if r["n"]:
            new[r["c"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return new, exact


def pivot_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                   dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2,
                   n_pivots: int = 12) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid), one row for each vector kept.

    Kept are vectors of exactly ``dim`` components, none NULL or non-finite, and none beyond
    ``largest_component(dim) / scale`` in size (some 700,000 for 64 components at scale 256),
    whose squared distances would leave 63 bits. They are turned to integers
    floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
    ``seed:id`` (NULL ids count as empty text; among equal ids the smaller vector comes first); if
    there are fewer vectors, so are centroids. Each of ``rounds`` rounds assigns all vectors to
    the nearest centroid and moves each centroid that has vectors to floor(sum / count).
    distance is squared; inertias are sums of it, NULL beyond 63 bits. Repeated rows are vectors
    of their own. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = integer_vectors(vectors, id_col, vec_col, dim, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))),
                  256)
    first = usable.orderBy(name, "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    kind = usable.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, "
                                     "cluster_inertia long, inertia long, centroid array<long>")
    pivots = far_apart(centroids, n_pivots)
    points = written(usable.mapInArrow(_with_pivots(pivots),
                                       f"id {kind}, v array<long>, far array<double>"), "points")
    for _ in range(rounds):
        centroids, _ = moved(points, centroids, pivots)
    own = written(points.mapInArrow(_assigned(centroids, pivots),
                                    f"id {kind}, cluster int, distance long"), "clusters")
    by_cluster = own.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    # at most k rows
    inertia = {r["cluster"]: r["cluster_inertia"] for r in by_cluster.collect()}
    parts = list(inertia.values())
    total = None if None in parts or sum(parts) >= 1 << 63 else sum(parts)
    table = spark.createDataFrame(
        [(c, i, total, centroids[c].tolist()) for c, i in inertia.items()],
        "c int, cluster_inertia long, inertia long, centroid array<long>")
    return own.join(F.broadcast(table), own["cluster"] == table["c"]).drop("c")

