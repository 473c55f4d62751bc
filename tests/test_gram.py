import numpy as np
import pytest
from pyspark.sql import GroupedData

from helpers import emb_frame
from isochord.operators.gram import gram_cka


def numpy_cka(x, y):
    x, y = x - x.mean(0), y - y.mean(0)
    k, l = x @ x.T, y @ y.T
    return (k * l).sum() / (np.sqrt((k * k).sum() * (l * l).sum()) + 1e-20)


@pytest.mark.parametrize("block", [None, 7])
def test_wider_than_long(spark, block):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 300)), rng.normal(size=(40, 170)) + 0.5
    y[:, :30] += x[:, :30]
    got = gram_cka(emb_frame(spark, x, grid="g", la=0), emb_frame(spark, y, grid="g", lb=0),
                   ["la"], ["lb"], ["grid"], 40, [0, 3, -5], block)
    found = {r["shift"]: r["cka"] for r in got.collect()}
    assert found == {s: pytest.approx(numpy_cka(x, np.roll(y, s, axis=0)), abs=1e-9)
                     for s in (0, 3, -5)}


def test_missing_windows_flat_spaces_and_nothing(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 50)), rng.normal(size=(20, 60))
    a, b = emb_frame(spark, x, grid="g", la=0), emb_frame(spark, y, grid="g", lb=0)
    part = gram_cka(a.filter("w >= 4"), b, ["la"], ["lb"], ["grid"], 20, [0], 5).collect()
    assert part[0]["cka"] == pytest.approx(numpy_cka(x[4:], y[4:]), abs=1e-9)
    flat = emb_frame(spark, np.ones((20, 30)), grid="g", lb=0)
    assert gram_cka(a, flat, ["la"], ["lb"], ["grid"], 20, [0]).collect()[0]["cka"] == \
        pytest.approx(0, abs=1e-6)
    assert gram_cka(a.limit(0), b, ["la"], ["lb"], ["grid"], 20, [0]).count() == 0


def joined_cka(a, b, n, shift):
    """From all joined rows; row sums are added by window."""
    (wa, x), (wb, y) = a, b
    p, q = np.nonzero(wa[:, None] == (wb[None] + shift) % n)
    if not len(p):
        return None
    k, l, at = x[p] @ x[p].T, y[q] @ y[q].T, wa[p]
    u, v = (np.array([m.sum(1)[at == w].sum() for w in np.unique(at)]) for m in (k, l))
    (kk, ll, kl) = ((m * o).sum() - 2 * (r @ t) / len(u) + r.sum() * t.sum() / len(u) ** 2
                    for m, o, r, t in ((k, k, u, u), (l, l, v, v), (k, l, u, v)))
    scale = np.sqrt(max(kk, 0) * max(ll, 0))
    return kl / (scale + 1e-20) if scale else 0


@pytest.mark.parametrize("kind,block", [("plain", None), ("plain", 9), ("missing", 100), ("twice", 100),
                                        ("twice and missing", 9), ("far apart", 100)])
def test_rotations_that_share_products(spark, kind, block):
    """Near and far rotations, also beyond the end, several stripes and blocks."""
    rng = np.random.default_rng(2)
    n, shifts = 260, [0, 1, 7, 24, 130, 259, -3, 262]
    x, y = rng.normal(size=(n, 5)) + 1, rng.normal(size=(n, 4))
    y[:, :3] += x[:, :3]
    wa = wb = np.arange(n)
    if "missing" in kind:
        wa, wb = np.delete(wa, [0, 5, 99, 100, 101, 258]), np.delete(wb, [3, 5, 200, 259])
    if "twice" in kind:
        wa, wb = np.r_[wa, wa[:7], 40, 40], np.r_[wb, wb[30:50]]
    if kind == "far apart":
        wa, wb = wa[wa % 5 == 0], wb[wb % 5 != 1]
    x, y = x[wa % n] + 0.1 * rng.normal(size=(len(wa), 5)), y[wb] + 0.1 * rng.normal(size=(len(wb), 4))
    empty = [("g", 0, 99, None), ("g", 0, None, [1.0] * 5)] if kind == "missing" else []
    a, b = (spark.createDataFrame([("g", 0, int(w), v.tolist()) for w, v in zip(at, m)] + more,
                                  f"grid string, {name} int, w bigint, vec array<double>")
            for at, m, name, more in ((wa, x, "la", empty), (wb, y, "lb", [])))
    got = gram_cka(a, b, ["la"], ["lb"], ["grid"], n, shifts, block).collect()
    want = {s: joined_cka((wa, x), (wb, y), n, s) for s in shifts}
    assert {r["shift"]: r["cka"] for r in got} == {
        s: pytest.approx(v, abs=1e-9) for s, v in want.items() if v is not None}


def test_vectors_travel_once_for_near_rotations(spark, monkeypatch):
    """Before, each rotation sent the vectors of both spaces to tiles of its own."""
    seen, group = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow",
                        lambda self, *a: seen.append(self._df) or group(self, *a))
    n = 3000
    x = np.random.default_rng(3).normal(size=(n, 2))
    gram_cka(emb_frame(spark, x, grid="g", la=0), emb_frame(spark, x, grid="g", lb=0),
             ["la"], ["lb"], ["grid"], n, [0, 1, 7, 97])
    assert max(df.count() for df in seen) <= 2 * n * 1.3


def test_not_finite_vectors_stay_in_their_rotation(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(30, 3))
    x[8] = np.nan
    a, b = emb_frame(spark, x, grid="g", la=0), emb_frame(spark, y, grid="g", lb=0).filter("w <> 7")
    got = {r["shift"]: r["cka"] for r in gram_cka(a, b, ["la"], ["lb"], ["grid"], 30, [0, 1]).collect()}
    rest = [w for w in range(30) if w != 8]
    assert np.isnan(got[0])
    assert got[1] == pytest.approx(numpy_cka(x[rest], y[[w - 1 for w in rest]]), abs=1e-9)
