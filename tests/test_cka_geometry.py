import numpy as np
import pytest

from helpers import brute_knn, emb_frame
from isochord.operators import cka, geometry, knn, moments, overlap


def gram(x):
    c = x - x.mean(0)
    g = c @ c.T
    return g / np.linalg.norm(g)


@pytest.mark.parametrize("w,dims", [(37, 5), (64, 9), (129, 7)])
@pytest.mark.parametrize("block", [16, 3])
def test_cka_at_every_rotation(spark, w, dims, block):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(w, dims)), rng.normal(size=(w, dims))
    a = emb_frame(spark, x, grid="g", la=0)
    b = emb_frame(spark, y, grid="g", lb=0)
    curve = {r["d"]: r["score"] for r in cka.cka_all_shifts(
        a, b, ["la"], ["lb"], ["grid"], w, feature_block=block).collect()}
    ds = [0, 1, 2, 7, w // 3, w - 1]
    direct = {r["shift"]: r["cka"] for r in cka.cka_at_shifts(
        a, b, ["la"], ["lb"], ["grid"], w, ds).collect()}
    ga, gb = gram(x), gram(y)
    assert sorted(curve) == list(range(w))
    for d in ds:
        at = (np.arange(w) - d) % w
        want = (ga * gb[np.ix_(at, at)]).sum()
        assert curve[d] == pytest.approx(want, abs=1e-9)
        assert direct[d] == pytest.approx(want, abs=1e-9)


def test_cka_of_a_space_with_itself_is_one(spark):
    x = np.random.default_rng(3).normal(size=(50, 6))
    got = cka.cka_at_shifts(emb_frame(spark, x, grid="g", la=0),
                            emb_frame(spark, x, grid="g", lb=0), ["la"], ["lb"], ["grid"], 50,
                            [0]).first()
    assert got["cka"] == pytest.approx(1.0)


def test_moments_over_many_partitions_and_keys(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.normal(size=(n, 3)) for k, n in (("a", 200), ("b", 11))}
    df = emb_frame(spark, x["a"], k="a").union(emb_frame(spark, x["b"], k="b")).repartition(5)
    got = {r["k"]: r for r in moments.moment_matrix(df, ["k"], "vec").collect()}
    for k, m in x.items():
        one = np.hstack([np.ones((len(m), 1)), m])
        row = got[k]
        assert np.allclose(moments.augmented(row["n"], row["total"], row["products"]), one.T @ one)


def test_spectrum(spark):
    x = np.random.default_rng(5).normal(size=(80, 5)) * [5, 3, 1, 1, 0.1]
    df = emb_frame(spark, x, grid="g")
    c = x - x.mean(0)
    ev = np.sort(np.linalg.eigvalsh(c.T @ c))[::-1]
    p = ev / ev.sum()
    row = geometry.spectrum_stats(df, ["grid"], 8).first()
    assert row["participation_ratio"] == pytest.approx(ev.sum() ** 2 / (ev ** 2).sum())
    assert row["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert row["eigenspectrum"][:5] == pytest.approx(list(p))
    assert row["eigenspectrum"][5:] == [None] * 3
    assert geometry.participation_ratio(df, ["grid"]).first()["participation_ratio"] \
        == pytest.approx(row["participation_ratio"])


def distances(x):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
    return np.sort(d, axis=1)


def two_nn(x):
    d = distances(x)
    mu = np.sort(d[:, 2] / np.maximum(d[:, 1], 1e-12))
    mu = mu[mu > 1 + 1e-12]
    mu = mu[:max(int(len(mu) * 0.9), 4)]
    f = np.arange(1, len(mu) + 1) / (len(mu) + 1)
    return np.polyfit(np.log(mu), -np.log(1 - f), 1)[0]


def test_intrinsic_dimension(spark):
    x = np.random.default_rng(6).normal(size=(150, 4))
    df = emb_frame(spark, x, grid="g")
    assert geometry.twonn_id(df, ["grid"]).first()["twonn_id"] == pytest.approx(two_nn(x))
    logs = np.log(distances(x)[:, 1:21])
    inv = np.mean([(logs[:, k - 1:k] - logs[:, :k - 1]).sum(1).mean() / (k - 1)
                   for k in range(10, 21)])
    assert geometry.mle_id(df, ["grid"]).first()["mle_id"] == pytest.approx(1 / inv)


def test_local_dimension(spark):
    x = np.random.default_rng(7).normal(size=(60, 5))
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["i"]: r["local_id"] for r in geometry.local_twonn(
        emb_frame(spark, x, grid="g"), ["grid"], 20).collect()}
    for i in (0, 17, 59):
        sim = z @ z[i]
        near = [j for j in np.argsort(-sim) if j != i][:20]
        assert got[i] == pytest.approx(two_nn(z[near]))


def test_absent_windows_add_nothing(spark):
    rng = np.random.default_rng(9)
    w, here = 40, np.array([i for i in range(40) if i % 7])
    x, y = rng.normal(size=(w, 5)) + 3, rng.normal(size=(w, 4)) - 2
    frames = [emb_frame(spark, m, grid="g", **k).filter("w % 7 != 0")
              for m, k in ((x, {"la": 0}), (y, {"lb": 0}))]
    curve = {r["d"]: r["score"] for r in cka.cka_all_shifts(
        *frames, ["la"], ["lb"], ["grid"], w).collect()}

    def kept(m):
        out = np.zeros_like(m)
        out[here] = m[here] - m[here].mean(0)
        return out
    cx, cy = kept(x), kept(y)
    scale = np.linalg.norm(cx.T @ cx) * np.linalg.norm(cy.T @ cy)
    for d in (0, 3, 7):
        want = np.square(cx.T @ np.roll(cy, d, axis=0)).sum() / scale
        assert curve[d] == pytest.approx(want, abs=1e-9)


def test_cka_without_leading_directions(spark):
    rng = np.random.default_rng(8)
    w = 60
    x, y = rng.normal(size=(w, 5)) * [6, 2, 1, 1, 1], rng.normal(size=(w, 4))
    got = {(r["shift"], r["r"]): r["cka"] for r in cka.cka_without_top(
        emb_frame(spark, x, grid="g", la=0), emb_frame(spark, y, grid="g", lb=0), ["la"], ["lb"],
        ["grid"], w, [0, 7], [0, 1, 3]).collect()}
    for d in (0, 7):
        z = np.roll(y, d, axis=0)
        for r in (0, 1, 3):
            left = []
            for m in (x, z):
                c = m - m.mean(0)
                u, s, vt = np.linalg.svd(c, full_matrices=False)
                s[:r] = 0
                left.append(gram(u @ np.diag(s) @ vt))
            assert got[(d, r)] == pytest.approx((left[0] * left[1]).sum(), abs=1e-9)


def test_overlap_by_neighbourhood_size(spark):
    rng = np.random.default_rng(9)
    w = 50
    x = rng.normal(size=(w, 4))
    y = x + rng.normal(size=(w, 4))
    ea, eb = (knn.knn_edges(emb_frame(spark, v, grid="g"), ["grid"], 20) for v in (x, y))
    got = {r["k"]: r["mknn"] for r in overlap.mknn_by_k(ea, eb, ["grid"], w, [5, 10, 20]).collect()}
    for k in (5, 10, 20):
        a, b = brute_knn(x, k), brute_knn(y, k)
        assert got[k] == pytest.approx(np.mean([len(set(p) & set(q)) / k for p, q in zip(a, b)]))
