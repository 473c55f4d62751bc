import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import brute_knn, edge_frame, emb_frame, literal_mknn, random_graph
from isochord.operators import knn, overlap, permute, shift_curve


def as_lists(df, n):
    rows = df.orderBy("i", "rank").collect()
    out = [[] for _ in range(n)]
    for r in rows:
        out[r["i"]].append(r["j"])
    return out


@pytest.mark.parametrize("block_rows", [2048, 17])
@pytest.mark.parametrize("excl,metric", [(0, "cosine"), (4, "cosine"), (0, "euclidean")])
def test_knn_equals_full_sort(spark, block_rows, excl, metric):
    x = np.random.default_rng(1).normal(size=(90, 6))
    got = knn.knn_edges(emb_frame(spark, x, space="s"), ["space"], 5, excl, metric, block_rows)
    assert as_lists(got, 90) == brute_knn(x, 5, excl, metric)
    known = knn.knn_edges(emb_frame(spark, x, space="s"), ["space"], 5, excl, metric, block_rows,
                          n_windows=90)
    assert as_lists(known, 90) == brute_knn(x, 5, excl, metric)


def test_knn_with_a_third_of_rows_identical(spark):
    x = np.random.default_rng(2).normal(size=(96, 5))
    x[::3] = x[0]
    got = knn.knn_edges(emb_frame(spark, x, space="s"), ["space"], 4, block_rows=20)
    assert as_lists(got, 96) == brute_knn(x, 4)
    assert got.filter("i = j").count() == 0


def test_knn_keeps_keys_apart_and_may_have_fewer_than_k(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(4, 4))
    both = emb_frame(spark, a, space="a").union(emb_frame(spark, b, space="b"))
    got = knn.knn_edges(both, ["space"], 5)
    assert as_lists(got.filter("space = 'a'"), 30) == brute_knn(a, 5)
    assert as_lists(got.filter("space = 'b'"), 4) == brute_knn(b, 5)


@pytest.mark.parametrize("d", [0, 1, 7, -3, 97, -150])
def test_relabel_equals_new_search(spark, d):
    w = 60
    x = np.random.default_rng(0).normal(size=(w, 8))
    edges = knn.knn_edges(emb_frame(spark, x, space="s"), ["space"], 5)
    moved = {(r["i"], r["j"]) for r in overlap.relabel(edges, d, w).collect()}
    again = brute_knn(np.roll(x, d, axis=0), 5)
    assert moved == {(i, j) for i, js in enumerate(again) for j in js}


@pytest.mark.parametrize("w,k", [(37, 3), (64, 5), (211, 5)])
@pytest.mark.parametrize("options", [{}, {"unroll_limit": 0}, {"unroll_limit": 0, "segment": 16},
                                     {"unroll_limit": 2, "segment": 16}])
def test_all_rotations_equal_recount(spark, w, k, options):
    rng = np.random.default_rng(0)
    a, b = random_graph(rng, w, k), random_graph(rng, w, k)
    got = shift_curve.shift_curve(edge_frame(spark, a, grid="g", la=0),
                                  edge_frame(spark, b, grid="g", lb=0), ["la"], ["lb"], ["grid"],
                                  w, k, **options).orderBy("d").collect()
    assert [r["d"] for r in got] == list(range(w))
    for d in (0, 1, 2, 7, w // 3, w - 1):
        assert got[d]["score"] == pytest.approx(literal_mknn(a, b, d), abs=1e-12)


def test_all_rotations_on_a_smooth_series(spark):
    """All edges share four offsets, which the packed correlation must count exactly."""
    w, k = 120, 4
    nn = np.stack([(np.arange(w) + o) % w for o in (1, -1, 2, -2)], axis=1)
    got = shift_curve.shift_curve(edge_frame(spark, nn, grid="g", la=0),
                                  edge_frame(spark, nn, grid="g", lb=0), ["la"], ["lb"], ["grid"],
                                  w, k, unroll_limit=100, segment=32).collect()
    assert len(got) == w and all(r["score"] == pytest.approx(1.0) for r in got)


def test_pair_list_limits_the_curves(spark):
    rng = np.random.default_rng(5)
    w, k = 40, 3
    graphs = [random_graph(rng, w, k) for _ in range(3)]
    e = None
    for n, g in enumerate(graphs):
        f = edge_frame(spark, g, grid="g", m=n)
        e = f if e is None else e.union(f)
    pairs = spark.createDataFrame([("g", 0, 2)], "grid string, ma int, mb int")
    got = shift_curve.shift_curve(e.withColumnRenamed("m", "ma"), e.withColumnRenamed("m", "mb"),
                                  ["ma"], ["mb"], ["grid"], w, k, pairs=pairs).collect()
    assert len(got) == w
    assert {r["d"]: r["score"] for r in got}[9] == pytest.approx(
        literal_mknn(graphs[0], graphs[2], 9))


def test_layer_grid_max_and_first_best(spark):
    rng = np.random.default_rng(7)
    w, k = 50, 4
    a = [random_graph(rng, w, k) for _ in range(2)]
    b = [random_graph(rng, w, k) for _ in range(3)]
    fa = edge_frame(spark, a[0], grid="g", la=0).union(edge_frame(spark, a[1], grid="g", la=1))
    fb = edge_frame(spark, b[0], grid="g", lb=0)
    for n in (1, 2):
        fb = fb.union(edge_frame(spark, b[n], grid="g", lb=n))
    grid = overlap.mknn(fa, fb, ["la"], ["lb"], ["grid"], w, k)
    want = {(i, j): literal_mknn(a[i], b[j], 0) for i in range(2) for j in range(3)}
    assert {(r["la"], r["lb"]): r["mknn"] for r in grid.collect()} == pytest.approx(want)
    best = overlap.best_pair(grid, ["grid"], ["la", "lb"]).first()
    first = min(p for p in want if want[p] == max(want.values()))
    assert (best["la"], best["lb"]) == first


def test_per_window_share(spark):
    rng = np.random.default_rng(8)
    a, b = random_graph(rng, 45, 5), random_graph(rng, 45, 5)
    got = {r["w"]: r["share"] for r in overlap.mknn_per_window(
        edge_frame(spark, a, grid="g"), edge_frame(spark, b, grid="g"), ["grid"], 5).collect()}
    assert got == pytest.approx({i: len(set(a[i]) & set(b[i])) / 5 for i in range(45)})


def test_permutations_are_bijections_and_blocks_stay_whole(spark):
    for t in (permute.permutation_table(spark, 53, 3),
              permute.block_permutation_table(spark, 53, 10, 3)):
        p = t.toPandas()
        for _, g in p.groupby("draw"):
            assert sorted(g["old"]) == sorted(g["new"]) == list(range(53))
    p = permute.block_permutation_table(spark, 53, 10, 3).toPandas().sort_values("old")
    for _, g in p.groupby("draw"):
        step = np.diff(g["new"].to_numpy())
        assert all(step[i] == 1 for i in range(52) if (i + 1) % 10)


def test_permuted_scores_equal_recount(spark):
    rng = np.random.default_rng(9)
    w, k = 30, 3
    a, b = random_graph(rng, w, k), random_graph(rng, w, k)
    perms = permute.permutation_table(spark, w, 4)
    pairs = spark.createDataFrame([("g", 0, 0)], "grid string, la int, lb int")
    got = {r["draw"]: r["score"] for r in permute.permuted_scores(
        edge_frame(spark, a, grid="g", la=0), edge_frame(spark, b, grid="g", lb=0), ["la"],
        ["lb"], ["grid"], perms, 4, w, k, pairs).collect()}
    tables = perms.toPandas()
    assert got[-1] == pytest.approx(literal_mknn(a, b, 0))
    for draw, g in tables.groupby("draw"):
        new = g.set_index("old")["new"]
        edges = {(new[i], new[int(j)]) for i in range(w) for j in b[i]}
        hits = sum((i, int(j)) in edges for i in range(w) for j in a[i])
        assert got[draw] == pytest.approx(hits / (w * k))


def test_truncating_scores_equal_recount(spark):
    rng = np.random.default_rng(10)
    w, k = 40, 3
    x, y = rng.normal(size=(w, 4)), rng.normal(size=(w, 4))
    got = {r["shift"]: r["score"] for r in shift_curve.truncating_scores(
        emb_frame(spark, x, grid="g", la=0), emb_frame(spark, y, grid="g", lb=0), ["la"], ["lb"],
        ["grid"], w, k, [0, 3, -5]).collect()}
    for d in (0, 3, -5):
        xs = x[max(0, d):w + min(0, d)]
        ys = y[-min(0, d):w - max(0, d)]
        na, nb = np.array(brute_knn(xs, k)), np.array(brute_knn(ys, k))
        assert got[d] == pytest.approx(literal_mknn(na, nb, 0))


@pytest.mark.parametrize("pairs", [False, True])
def test_all_edges_on_one_offset_of_many_segments(spark, pairs):
    """Lag blocks count exactly, and no group of segments is much larger than the others."""
    w, segment = 1000, 40
    nn = ((np.arange(w) + 1) % w)[:, None]
    a = edge_frame(spark, nn, grid="g", la=0).union(edge_frame(spark, nn[::-1].copy() * 0, grid="g", la=1))
    b = edge_frame(spark, nn, grid="g", lb=0)
    listed = spark.createDataFrame([("g", 0, 0)], "grid string, la int, lb int") if pairs else None
    counts = shift_curve.shift_counts(a, b, ["la"], ["lb"], ["grid"], w, listed, segment,
                                      unroll_limit=500)
    got = {(r["la"], r["d"]): r["hits"] for r in counts.collect()}
    assert all(got[0, d] == w for d in range(w))
    # the other space has each offset once
    assert {la for la, _ in got} == ({0} if pairs else {0, 1})
    assert pairs or sum(v for (la, _), v in got.items() if la == 1) == w
    pa = shift_curve.packed(a.filter("la = 0"), ["grid", "la"], w, "a", segment)
    pb = shift_curve.packed(b, ["grid", "lb"], w, "b", segment)
    left, right = shift_curve.lag_groups(pa, pb, w, segment)
    sizes = (left.select("apart", "part", F.size("pos_a").alias("n"))
             .union(right.select("apart", "part", F.size("pos_b").alias("n")))
             .groupBy("apart", "part").agg(F.sum("n").alias("n")).toPandas()["n"])
    assert len(sizes) > 100 and sizes.max() <= 2 * sizes.median()
