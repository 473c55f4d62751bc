import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isochord.functions.dist import t_two_sided
from isochord.functions.labels import params_label, performance_axis, sig_stars
from isochord.functions.vectors import signed_shift
from isochord.operators import calibrate as cal
from isochord.operators import decode, permute, stats


def curve_frame(spark, curves):
    rows = [(k, d, float(v)) for k, c in curves.items() for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "k string, d long, score double")


def curves(w=211, seed=0):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 12, w) / 50.0
    coarse[0] = 0.2
    return {"coarse": coarse, "fine": rng.random(w) / 3, "zero": np.zeros(w)}


def test_cyclic_calibration(spark):
    w, data = 211, curves()
    got = {r["k"]: r for r in
           cal.calibrate_cyclic(curve_frame(spark, data), ["k"], w).collect()}
    for k, c in data.items():
        obs, null = c[0], c[1:]
        tau = np.sort(c)[math.ceil(0.95 * w) - 1]
        r = got[k]
        assert r["obs"] == pytest.approx(obs) and r["tau"] == pytest.approx(tau)
        assert r["p"] == pytest.approx((1 + (null >= obs).sum()) / w)
        assert r["s_cal"] == pytest.approx(max((obs - tau) / (1 - tau), 0))
        assert r["excess"] == pytest.approx(obs - null.mean())


def test_linear_calibration_and_percentiles(spark):
    w, data = 211, curves(seed=2)
    df = curve_frame(spark, data)
    got = {r["k"]: r for r in cal.calibrate_linear(
        df, ["k"], F.col("d") == 0, F.col("d") != 0).collect()}
    pct = {r["k"]: r for r in cal.null_percentiles(
        df, ["k"], F.col("d") != 0, {"p05": 0.05, "p95": 0.95}).collect()}
    for k, c in data.items():
        tau = np.quantile(c[1:], 0.95)
        assert got[k]["tau"] == pytest.approx(tau)
        assert got[k]["s_cal"] == pytest.approx(max(c[0] - tau, 0) / (1 - tau))
        assert pct[k]["p05"] == pytest.approx(np.quantile(c[1:], 0.05))
        assert pct[k]["p95"] == pytest.approx(tau)


@pytest.mark.parametrize("tail_min", [40, 0])
def test_tail_statistics(spark, tail_min):
    w, data = 211, curves(seed=3)
    got = {r["k"]: r for r in cal.shift_pvalues(curve_frame(spark, data), ["k"], w,
                                               tail_min).collect()}
    d = np.arange(w)
    signed = np.where(d <= w // 2, d, d - w)
    tail = np.abs(signed) >= tail_min if tail_min > 0 else d != 0
    for k, c in data.items():
        t, r = c[tail], got[k]
        assert r["n_tail"] == tail.sum()
        assert r["tail_mean"] == pytest.approx(t.mean())
        assert r["tail_sd"] == pytest.approx(t.std(ddof=1), abs=1e-12)
        assert r["p_tail"] == pytest.approx((2 + (t >= c[0]).sum()) / (len(t) + 2))
        assert r["p_all"] == pytest.approx((1 + (c >= c[0]).sum()) / (w + 1))
        assert r["slope"] == pytest.approx(np.polyfit(signed, c, 1)[0], abs=1e-12)
        if t.std() > 0:
            assert r["z_tail"] == pytest.approx((c[0] - t.mean()) / t.std(ddof=1))
        else:
            assert r["z_tail"] is None


def test_signed_shift(spark):
    for w in (6, 7):
        got = [r[0] for r in spark.range(w).select(signed_shift(F.col("id"), w)).collect()]
        assert got == [d if d <= w // 2 else d - w for d in range(w)]


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def hot_values(n=300, seed=0):
    """A third of all values identical, the rest with some ties."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n) * 3, 1)
    x[: n // 3] = 0.7
    return rng.permutation(x)


def test_two_sample_statistics(spark):
    x = hot_values()
    is_a = np.arange(300) % 3 == 0
    a, b = x[is_a], x[~is_a]
    df = frame(spark, g=["all"] * 300, x=x, a=is_a)
    auc = np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None]))
    grid = np.unique(x)
    ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    pooled = np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / 298)
    assert stats.cles_auc(df, ["g"], "x", F.col("a")).first()["auc"] == pytest.approx(auc)
    assert stats.ks_stat(df, ["g"], "x", F.col("a")).first()["ks"] == pytest.approx(ks)
    assert stats.cohens_d(df, ["g"], "x", F.col("a")).first()["cohens_d"] == pytest.approx(
        (a.mean() - b.mean()) / (pooled + 1e-12))


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 9), min_size=2, max_size=40))
def test_gini_on_any_values(spark, values):
    x = np.sort(np.array(values, float))
    x = x - x.min() if x.min() < 0 else x
    cum = np.cumsum(x)
    want = (len(x) + 1 - 2 * (cum / cum[-1]).sum()) / len(x) if cum[-1] > 0 else 0.0
    got = stats.gini(frame(spark, x=np.array(values, float)), [], "x").first()["gini"]
    assert got == pytest.approx(want, abs=1e-9)


def test_gini_of_a_constant_is_zero(spark):
    assert stats.gini(frame(spark, x=[2.0] * 9), [], "x").first()["gini"] == pytest.approx(0.0)


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(120), 2)
    p[:40] = 0.03
    p[50:55] = np.nan
    df = frame(spark, id=np.arange(120), p=p)
    got = np.array([np.nan if r["q"] is None else r["q"] for r in
                    stats.benjamini_hochberg(df, "p").orderBy("id").collect()])
    ok = np.isfinite(p)
    order = np.argsort(p[ok], kind="stable")
    ranked = p[ok][order] * ok.sum() / np.arange(1, ok.sum() + 1)
    ranked = np.minimum.accumulate(ranked[::-1])[::-1].clip(max=1)
    want = np.full(120, np.nan)
    want[np.where(ok)[0][order]] = ranked
    assert np.allclose(got, want, equal_nan=True)
    by_p = sorted((a, b) for a, b in zip(p[ok], got[ok]))
    assert all(b1 <= b2 + 1e-12 for (_, b1), (_, b2) in zip(by_p, by_p[1:]))


def test_spearman_with_ties_and_p(spark):
    x, y = hot_values(60, 1), hot_values(60, 2)
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    rho = np.corrcoef(rx, ry)[0, 1]
    r = stats.spearman(frame(spark, x=x, y=y), [], "x", "y").first()
    t = rho * np.sqrt(58 / (1 - rho ** 2))
    assert r["rho"] == pytest.approx(rho) and r["n"] == 60
    assert r["p"] == pytest.approx(t_two_sided(np.array([t]), np.array([58]))[0])


@pytest.mark.parametrize("t,df,p", [(0.0, 5, 1.0), (12.706204736, 1, 0.05), (2.570581836, 5, 0.05),
                                    (2.228138852, 10, 0.05), (1.984467455, 98, 0.05),
                                    (63.656741163, 1, 0.01)])
def test_student_t_table(t, df, p):
    assert t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=2e-4)


def ols(y, cols):
    a = np.column_stack([np.ones(len(y)), *cols])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    res = y - a @ beta
    return beta, res


def test_regressions(spark):
    rng = np.random.default_rng(6)
    n = 90
    fam = rng.choice(["u", "v", "w"], n, p=[0.6, 0.3, 0.1])
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = x + 0.5 * z + (fam == "v") * 2 + rng.normal(size=n)
    df = frame(spark, fam=fam, x=x, y=y, z=z)
    tot = ((y - y.mean()) ** 2).sum()
    r2 = {c: 1 - (ols(y, v)[1] ** 2).sum() / tot for c, v in
          (("r2_1", [x]), ("r2_2", [z]), ("r2_full", [x, z]))}
    got = stats.variance_partition_2(df, [], "y", "x", "z").first()
    for c, v in r2.items():
        assert got[c] == pytest.approx(v)
    pc = stats.partial_corr_1(df, [], "x", "y", "z").first()["partial_corr"]
    assert pc == pytest.approx(np.corrcoef(ols(x, [z])[1], ols(y, [z])[1])[0, 1])
    dummies = [(fam == f).astype(float) for f in ("v", "w")]
    beta, res = ols(y, [x, *dummies])
    reduced = (ols(y, dummies)[1] ** 2).sum()
    sse = (res ** 2).sum()
    a = stats.ancova(df, "fam", "x", "y").first()
    assert a["slope_adj"] == pytest.approx(beta[1])
    assert a["slope_unadj"] == pytest.approx(np.polyfit(x, y, 1)[0])
    assert a["partial_eta2"] == pytest.approx((reduced - sse) / reduced)
    t = np.sqrt((reduced - sse) / (sse / (n - 4)))
    assert a["p"] == pytest.approx(t_two_sided(np.array([t]), np.array([n - 4]))[0])


def brute_ridge(x, y, alphas=decode.ALPHAS, n_folds=5):
    """Fold by fold with a decomposition of the training data itself."""
    n = len(x)
    edges = [int(v) for v in np.linspace(0, n, n_folds + 1)]
    score, count = np.zeros((len(alphas), y.shape[1])), np.zeros(y.shape[1])
    for lo, hi in zip(edges, edges[1:]):
        test = np.zeros(n, bool)
        test[lo:hi] = True
        mu, sd = x[~test].mean(0), x[~test].std(0) + 1e-8
        a, b = (x[~test] - mu) / sd, (x[test] - mu) / sd
        centre = y[~test].mean(0)
        ok = y[test].var(0) > 1e-9
        count += ok
        for i, alpha in enumerate(alphas):
            beta = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ (y[~test] - centre))
            err = ((y[test] - b @ beta - centre) ** 2).sum(0)
            r2 = np.clip(1 - err / (y[test].var(0) * (hi - lo) + 1e-12), -10, 1)
            score[i] += np.where(ok, r2, 0)
    with np.errstate(invalid="ignore"):
        best = (score / np.where(count > 0, count, np.nan)).max(0)
    return np.where(y.var(0) > 1e-9, best, np.nan)


def test_ridge_from_moments(spark):
    rng = np.random.default_rng(8)
    n, dims = 103, 6
    vec = rng.normal(size=(n, dims))
    x = vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-12)
    y = np.column_stack([x @ rng.normal(size=dims) + 0.1 * rng.normal(size=n),
                         rng.normal(size=n), np.full(n, 3.0)])
    emb = spark.createDataFrame(pd.DataFrame(
        {"m": ["a"] * n, "w": np.arange(n), "vec": vec.tolist()}))
    feats = spark.createDataFrame(pd.DataFrame(
        {"w": np.arange(n), **{f"f{i}": y[:, i] for i in range(3)}}))
    r2 = decode.ridge_r2(emb, feats, ["m"], [], ["f0", "f1", "f2"], n)
    got = {r["feature"]: r["r2"] for r in r2.collect()}
    want = brute_ridge(x, y)
    assert got["f0"] == pytest.approx(want[0], abs=1e-8) and want[0] > 0.5
    assert got["f1"] == pytest.approx(want[1], abs=1e-8)
    assert got["f2"] is None and math.isnan(want[2])
    assert decode.decodability(r2, ["m"]).first()["decodability"] == pytest.approx(
        (want[0] + want[1]) / 2, abs=1e-8)


def test_clean_features(spark):
    df = spark.createDataFrame([("s", 0, 1.0, None), ("s", 1, float("nan"), None),
                                ("s", 2, 3.0, None), ("s", 3, float("inf"), None)],
                               "s string, w int, a double, b double")
    got = [(r["a"], r["b"]) for r in decode.clean_features(df, ["s"], ["a", "b"])
           .orderBy("w").collect()]
    assert got == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.0, 0.0)]


def test_folds_are_not_equal_tiles():
    assert decode.fold_bounds(103) == [0, 20, 41, 61, 82, 103]


def test_neighbourhood_tests(spark):
    rng = np.random.default_rng(9)
    n = 40
    nn = np.stack([rng.choice(n, 5, replace=False) for _ in range(n)])
    f = rng.normal(size=n)
    edges = spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(n), 5),
                                               "j": nn.ravel()}))
    feats = spark.createDataFrame(pd.DataFrame({"w": np.arange(n), "f": f}))
    v = permute.varratio(edges, feats, ["f"], n, 10).first()
    ratio = [f[s].var(ddof=1) / (f.var(ddof=1) + 1e-12) for s in nn]
    assert v["median_ratio"] == pytest.approx(np.median(ratio)) and v["n_used"] == n
    assert 1 / 11 <= v["p"] <= 1
    e = permute.neighbour_enrichment(edges, feats, ["f"], n, 20).first()
    near = f[nn.ravel()]
    assert e["mean_shift_sigma"] == pytest.approx((near.mean() - f.mean()) / f.std(), abs=1e-6)
    assert e["var_ratio"] == pytest.approx(near.var() / f.var(), abs=1e-6)
    emb = rng.normal(size=(n, 3))
    vecs = spark.createDataFrame(pd.DataFrame({"w": np.arange(n), "vec": emb.tolist()}))
    t = permute.trace_cov_ratio(edges, vecs, n, 5).first()
    want = np.median([emb[s].var(0, ddof=1).sum() / emb.var(0, ddof=1).sum() for s in nn])
    assert t["median_ratio"] == pytest.approx(want)


def test_moments_of_draws_over_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(permute, "MEET_WINDOWS", 16)
    monkeypatch.setattr(permute, "MEET_DRAWS", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(5, 1, (50, 2))
    draws = rng.integers(0, 50, (7, 30))
    draws[:, 0] = 49
    places = spark.createDataFrame([(d, int(w)) for d in range(7) for w in draws[d]],
                                   "draw long, w long")
    feats = spark.createDataFrame([(w, [None if w % 5 == 0 else float(x[w, 0]), float(x[w, 1]), None])
                                   for w in range(50)], "w long, x array<double>")
    got = {(r["draw"], r["f"]): r for r in
           permute.drawn_moments(places, feats, 3, 7).collect()}
    assert len(got) == 21
    for d in range(7):
        for f, keep in ((0, draws[d] % 5 != 0), (1, draws[d] >= 0)):
            v = x[draws[d][keep], f]
            assert got[d, f]["mean"] == pytest.approx(v.mean())
            assert got[d, f]["var"] == pytest.approx(v.var())
        assert got[d, 2]["mean"] is None and got[d, 2]["var"] is None


def test_labels(spark):
    row = spark.createDataFrame([(0.0005, 0.005, 0.03, 0.5, 86, 1100)],
                                "a double, b double, c double, d double, m int, g int")
    assert row.select(*[sig_stars(F.col(c)) for c in "abcd"]).first()[:] == ("***", "**", "*", "ns")
    assert row.select(params_label(F.col("m")), params_label(F.col("g"))).first()[:] \
        == ("86M", "1.1B")


def test_performance_axis(spark):
    none = spark.createDataFrame([("a", None, 100), ("b", None, 1000)],
                                 "stem string, perf double, params_m int")
    assert [r["x"] for r in performance_axis(none).orderBy("stem").collect()] == [2.0, 3.0]
    some = spark.createDataFrame([("a", 0.2, 100), ("b", None, 1000)],
                                 "stem string, perf double, params_m int")
    with pytest.raises(Exception, match="measured performance"):
        performance_axis(some).collect()
