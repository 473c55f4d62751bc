"""Steps that must not grow faster than the recording, and joins that must not be broadcast."""

import numpy as np
import pytest

from helpers import brute_knn, edge_frame, emb_frame, literal_mknn, random_graph
from isochord.operators import gram, knn, overlap, permute, shift_curve
from isochord.operators import knn_pivots as kp
from isochord.plans import alignment


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["plain", "copies", "near", "windows twice"])
@pytest.mark.parametrize("excl", [0, 6])
def test_single_precision_finds_what_double_precision_finds(kind, excl):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    if kind == "copies":
        x[::3] = x[0]
    if kind == "near":
        x[::3] = x[0] + rng.normal(0, 1e-5, x[::3].shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    w = rng.permutation(len(x)) // (2 if kind == "windows twice" else 1)
    q, o, s, p = knn._best(x[:700], w[:700], x, w, 5, excl, "cosine")
    dq, do, ds, dp = knn._dense(x[:700], w[:700], x, w, 5, excl, "cosine")
    assert (q == dq).all() and (w[o] == w[do]).all() and (p == dp).all()
    assert np.abs(s - ds).max() < 1e-11


def test_candidates_stay_few():
    """Most pairs are settled by the single product."""
    x = np.random.default_rng(4).normal(size=(6000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    none = np.zeros(256, np.int64)
    q, _ = knn._candidates(x[:256], x, none, none, 5, 1e-6)
    assert 5 * 256 <= len(q) < 6 * 256


def test_both_sides_of_a_long_recording_from_one_search(spark):
    rng = np.random.default_rng(6)
    w, k = 60, 3
    graphs = [random_graph(rng, w, k) for _ in range(2)]
    e = edge_frame(spark, graphs[0], grid="g", m="x").union(
        edge_frame(spark, graphs[1], grid="g", m="y"))
    pairs = spark.createDataFrame([("g", "x", "y")], "grid string, ma string, mb string")
    got = shift_curve.shift_curve(e.withColumnRenamed("m", "ma"), e.withColumnRenamed("m", "mb"),
                                  ["ma"], ["mb"], ["grid"], w, k, pairs=pairs, segment=16,
                                  unroll_limit=2).collect()
    assert {r["d"]: r["score"] for r in got} == {
        d: pytest.approx(literal_mknn(*graphs, d)) for d in range(w)}


def test_neighbours_and_draws_are_not_broadcast(spark):
    rng = np.random.default_rng(7)
    a = emb_frame(spark, rng.normal(size=(20, 4)), grid="g", la=0)
    b = emb_frame(spark, rng.normal(size=(20, 4)), grid="g", lb=0)
    e = knn.knn_edges(a, ["grid", "la"], 2)
    f = knn.knn_edges(b, ["grid", "lb"], 2)
    met = overlap.shared_edges(e, f, ["grid"])
    drawn = permute.drawn_samples(a.select("w", "vec"), ["i"], permute.usable_sets(e), 20, 3)
    for df in (met, drawn, overlap.mknn_by_k(e, f, ["grid"], 20, [1, 2])):
        assert "SortMergeJoin" in planned(df) and "BroadcastHashJoin" not in planned(df)


def test_copies_of_a_row_in_block_pairs_are_bounded(spark):
    for n in (100_000, 700_000):
        assert knn.n_blocks(None, n) <= knn.BLOCKS_WANTED + 1


def test_windows_are_sent_to_regions(spark):
    """Without clusters every cell is needed, but a window travels once a region (here one)."""
    n = 600
    emb = emb_frame(spark, np.random.default_rng(5).normal(size=(n, 16)), space="s")
    rows, pivots, sizes = kp.cells(emb, ["space"], "cosine", 20)
    floors = rows.selectExpr("space", "w AS i", "double(-1) AS floor")
    assert pivots.count() > 10
    assert kp.needed(rows, floors, pivots, sizes, ["space"]).count() <= n


def test_tiles_of_a_long_recording(spark, monkeypatch):
    monkeypatch.setattr(gram, "STRIP", 1 << 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(26000, 1))
    both = emb_frame(spark, x, grid="g").selectExpr("grid", "w", "vec AS vec_a", "vec AS vec_b")
    by = gram.tile_sums(both, ["grid"], n_tasks=20).selectExpr(
        "count(*) / 26000 AS copies", "sum(k) AS k", "sum(kl) AS kl").first()
    assert by["copies"] <= 12
    assert by["k"] == pytest.approx(x.sum() ** 2) and by["kl"] == pytest.approx((x * x).sum() ** 2)


@pytest.mark.parametrize("smooth", [False, True])
def test_neighbours_of_every_cut_come_from_one_search(spark, smooth, monkeypatch):
    """Before, each of the shifts was a search of its own."""
    rng = np.random.default_rng(9)
    n, k, cuts = 70, 3, [-9, -4, 0, 2, 7]
    x = np.cumsum(rng.normal(size=(n, 4)), axis=0) if smooth else rng.normal(size=(n, 4))
    searches = []
    search = shift_curve.knn_edges
    monkeypatch.setattr(shift_curve, "knn_edges", lambda *a, **b: searches.append(a) or search(*a, **b))
    emb = emb_frame(spark, x, grid="g")
    found = shift_curve.cut_edges(emb, ["grid"], n, k, cuts).collect()
    assert len(searches) == 1 and "shift" not in searches[0][0].columns
    for c in cuts:
        begin, end = max(0, c), n + min(0, c)
        want = {(i + begin, j + begin) for i, near in enumerate(brute_knn(x[begin:end], k)) for j in near}
        assert {(r["i"], r["j"]) for r in found if r["low"] <= c <= r["high"]} == want
    twice = shift_curve.cut_edges(emb.union(emb), ["grid"], n, k, cuts).collect()
    assert max(sum(r["low"] <= c <= r["high"] for r in twice if r["i"] == 30) for c in cuts) == 2 * k


def test_models_of_a_long_recording_are_searched_once(spark, tmp_path, monkeypatch):
    """Before, the neighbours of all models were sought again for the other side of their pairs."""
    x = np.random.default_rng(11).normal(size=(40, 64))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                          "vec_id bigint, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    short = alignment.model_curves(spark, str(tmp_path))
    monkeypatch.setattr(shift_curve, "SEGMENT", 16)
    long = alignment.model_curves(spark, str(tmp_path))
    assert "FlatMapGroupsInArrow" in planned(short) and "FlatMapGroupsInArrow" not in planned(long)
    cols = ["model_a", "model_b", "d", "score"]
    assert sorted(short.select(*cols).collect()) == sorted(long.select(*cols).collect())


def test_draws_are_made_once(spark):
    """Before, every reading of the ratios drew and gathered the windows of all draws again."""
    x = np.random.default_rng(12).normal(size=(30, 4))
    emb = emb_frame(spark, x, grid="g")
    e = knn.knn_edges(emb, ["grid"], 3).select("i", "j")
    features = emb.selectExpr("w", "vec[0] AS x")
    assert "collect_list" in planned(permute.trace_cov(emb.withColumn("i", emb.w % 5), ["i"]))
    assert "collect_list" not in planned(permute.trace_cov_ratio(e, emb, 30, 4))
    assert "var_samp" not in planned(permute.varratio(e, features, ["x"], 30, 4))


def test_permuted_edges_travel_packed_and_equal_a_recount(spark, monkeypatch):
    """Many ranges of windows, sets of draws, repeated edges and two layers on either side."""
    monkeypatch.setattr(permute, "CUT_BITS", 3)
    monkeypatch.setattr(permute, "CUT", 8)
    monkeypatch.setattr(permute, "RANGES", 3)
    rng = np.random.default_rng(12)
    w, k, draws = 50, 3, 10
    sides = {(x, n): random_graph(rng, w, k) for x in "ab" for n in (0, 1)}
    e = {x: edge_frame(spark, sides[x, 0], grid="g", **{f"l{x}": 0}).union(
        edge_frame(spark, sides[x, 1], grid="g", **{f"l{x}": 1})) for x in "ab"}
    twice = e["b"].union(e["b"].filter("i < 7"))
    perms = permute.permutation_table(spark, w, draws)
    pairs = spark.createDataFrame([("g", 0, 0), ("g", 0, 1), ("g", 1, 1)],
                                  "grid string, la int, lb int")
    rows = permute.permuted_scores(e["a"], twice, ["la"], ["lb"], ["grid"], perms, draws, w, k,
                                   pairs).collect()
    got = {(r["la"], r["lb"], r["draw"]): r["score"] for r in rows}
    new = {d: g.set_index("old")["new"] for d, g in perms.toPandas().groupby("draw")}
    new[-1] = np.arange(w)
    expected = {}
    for la, lb in ((0, 0), (0, 1), (1, 1)):
        edges = {(i, int(j)) for i in range(w) for j in sides["a", la][i]}
        for d, to in new.items():
            hits = sum((2 if i < 7 else 1) * ((to[i], to[int(j)]) in edges)
                       for i in range(w) for j in sides["b", lb][i])
            expected[la, lb, d] = pytest.approx(hits / (w * k))
    assert got == expected and sum(got.values()) > 0
    moved = permute.moved_edges(e["b"], ["grid", "lb"], perms, draws, w)
    per_row = moved.select("code").toPandas()["code"].map(len)
    assert per_row.sum() == 2 * w * k * draws and per_row.mean() > 4
