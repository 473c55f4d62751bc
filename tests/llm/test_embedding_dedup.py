import math

import numpy as np
import pytest

from isochord.llm import embedding_dedup as ed


def data():
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(150)]
    for i in range(60):       # chains and clusters of near copies
        base = np.array(rows[i % 7][1])
        rows.append((200 + i, (base + 0.12 * rng.standard_normal(16) * (i % 4)).tolist(),
                     rows[i % 7][2]))
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [nan] + [1.0] * 15, 0),
             (303, [inf] + [1.0] * 15, 0), (304, [None] + [1.0] * 15, 0), (305, [], 0),
             (306, rows[0][1], None), (307, rows[0][1], 1), (308, [1.0, 2.0], 0),
             (309, [1.0, 2.0], 0), (310, [1e-3, 2e-3], 0), (None, rows[3][1], 0), (4, rows[4][1], 1)]
    return rows


def good(v, label):
    return (label is not None and v and all(x is not None and math.isfinite(x) for x in v)
            and any(v))


def brute(rows, threshold):
    n = len(rows)
    links, at = [0] * n, list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i
    for i in range(n):
        for j in range(i):
            (_, u, k), (_, v, m) = rows[i], rows[j]
            if good(u, k) and good(v, m) and k == m and len(u) == len(v):
                u, v = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    at[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [8192, 16])
def test_equals_brute_force(spark, block):
    rows = data()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ed.embedding_groups(frame.selectExpr("*", "1 AS rid", "'a' AS node"), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 0.93)
    if block == 16:
        assert ed.embedding_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [5, 64, 300])
def test_estimates_are_unbiased_and_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    o = rng.standard_normal((400, dim))
    q = o + rng.standard_normal((400, dim)) * rng.choice([0.1, 0.3, 1, 3], (400, 1))
    o, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (o, q))
    true = np.einsum("ij,ij->i", o, q)
    errors = []
    for seed in range(20):
        _, bits, factors = ed.coded(o, seed)
        estimate, upper = ed.estimates(bits, factors, ed.coded(q, seed)[0])
        assert (np.diag(upper) >= true - ed.SLACK).all()
        errors.append(np.diag(estimate) - true)
    assert abs(np.mean(errors)) < 0.02


def test_most_pairs_need_no_recomputation():
    rng = np.random.default_rng(0)
    o = rng.standard_normal((1000, 64))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    turned, bits, factors = ed.coded(o)
    _, upper = ed.estimates(bits, factors, turned)
    assert (upper >= 0.93).mean() < 0.01
