import hashlib

import numpy as np
import pytest

from isochord.llm import clustering as cl


def brute(rows, dim=64, k=40, rounds=5, scale=256, seed=2):
    """{row: (cluster, distance, cluster inertia, inertia, centroid)} with Python's integers."""
    kept = {i: np.floor(np.array(v, float) * scale).astype(np.int64)
            for i, (_, v) in enumerate(rows)
            if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()}
    name = {i: hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode())
            .hexdigest() for i in kept}
    order = sorted(kept, key=lambda i: (name[i], kept[i].tolist()))
    centroids = [kept[i].tolist() for i in order[:k]]

    def assign():
        c = np.array(centroids)
        out = {}
        for i, v in kept.items():
            d = np.square(c - v).sum(1)
            out[i] = (int(d.argmin()), int(d.min()))
        return out
    for _ in range(rounds):
        members = {}
        for i, (c, _) in assign().items():
            members.setdefault(c, []).append(kept[i])
        for c, vs in members.items():
            centroids[c] = [int(x) // len(vs) for x in np.sum(vs, axis=0)]
    final = assign()
    own = {c: sum(d for x, d in final.values() if x == c) for c, _ in final.values()}
    return {i: (c, d, own[c], sum(own.values()), centroids[c]) for i, (c, d) in final.items()}


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "'x' AS id", "1 AS cluster", "'y' AS far").repartition(3)
    got = cl.pivot_clusters(df, **options)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(rows[i][0], *w) for i, w in brute(rows, **options).items()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    mid = rng.normal(0, 0.4, (12, dim))
    x = mid[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, dim))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n", [3, 900])
def test_equals_brute_force(spark, n):
    compare(spark, clustered(n, 64, n))


def test_bad_vectors_repeats_and_null_ids(spark):
    rows = clustered(120, 8, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(1, None), (2, []), (3, [1.0] * 7), (4, [1.0] * 9), (5, [None] + [1.0] * 7),
             (6, [nan] * 8), (7, [inf] + [0.0] * 7), (None, [0.5] * 8), (None, [0.25] * 8),
             (8, [0.0] * 8), (8, [-0.0] * 8), (9, rows[0][1])] + [(500, rows[3][1])] * 60
    compare(spark, rows, dim=8, k=6)


def test_large_components_are_left_out(spark):
    most = cl.largest_component(4) / 256
    rows = [(1, [most * 0.99] * 4), (2, [-most * 0.99] * 4), (3, [most * 1.01] * 4), (4, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cl.pivot_clusters(df, dim=4, k=1, rounds=0).collect()
    assert sorted(r.id for r in got) == [1, 2, 4]
    assert all(0 <= r.distance < 2 ** 63 for r in got)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 0, 2])]
    for k in (2, 3, 7):
        compare(spark, rows, dim=2, k=k, scale=1)


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cl.pivot_clusters(df).count() == 0
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert cl.pivot_clusters(df).count() == 0


def test_bounds_spare_exact_distances():
    rng = np.random.default_rng(4)
    points = np.array([v for _, v in clustered(3000, 64, 2)])
    points = np.floor(points * 256).astype(np.int64)
    centroids = points[rng.choice(3000, 40, replace=False)]
    pivots = cl.far_apart(centroids, 12)
    label, best, exact = cl.nearest(points, cl.pivot_distances(points, pivots), centroids, pivots)
    d = np.square(points[:, None] - centroids[None]).sum(2)
    assert (label == d.argmin(1)).all() and (best == d.min(1)).all()
    assert exact < 0.5 * d.size


def test_whole_table(spark):
    from isochord.llm.queries import QUERIES
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in
            spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = {(rows[i][0], *w[:4], hashlib.sha256(",".join(map(str, w[4])).encode()).hexdigest())
            for i, w in brute(rows).items()}
    assert set(map(tuple, QUERIES["op13_clusters"](spark, path).collect())) == want
