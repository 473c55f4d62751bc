import numpy as np
import pytest

from helpers import brute_knn, emb_frame
from isochord.operators import knn_pivots as kp


def as_lists(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("i", "rank").collect():
        out[r["i"]].append(r["j"])
    return out


def clustered(n, d, groups, spread, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + rng.normal(
        0, spread, (n, d))


@pytest.mark.parametrize("excl,metric", [(0, "cosine"), (3, "cosine"), (0, "euclidean")])
@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_equals_full_sort(spark, excl, metric, spread):
    x = clustered(160, 6, 8, spread, 1)
    x[7] = 0
    got = kp.pruned_knn_edges(emb_frame(spark, x, space="s"), ["space"], 5, excl, metric, 20)
    assert as_lists(got, 160) == brute_knn(x, 5, excl, metric)


def test_a_third_of_rows_identical_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(kp, "STEP_ROWS", 16)
    x = clustered(120, 5, 6, 0.05, 2)
    x[::3] = x[0]
    got = kp.pruned_knn_edges(emb_frame(spark, x, space="s"), ["space"], 4, cell_rows=15)
    assert as_lists(got, 120) == brute_knn(x, 4)


def test_spaces_apart_fewer_than_k_and_nothing(spark):
    a, b = clustered(60, 4, 5, 0.1, 3), clustered(4, 4, 2, 0.1, 4)
    both = emb_frame(spark, a, space="a").union(emb_frame(spark, b, space="b"))
    got = kp.pruned_knn_edges(both, ["space"], 5, cell_rows=10)
    assert as_lists(got.filter("space = 'a'"), 60) == brute_knn(a, 5)
    assert as_lists(got.filter("space = 'b'"), 4) == brute_knn(b, 5)
    assert kp.pruned_knn_edges(both.limit(0), ["space"]).count() == 0


def test_pairs_that_cannot_hold_a_neighbour_are_skipped(spark):
    n, cell_rows = 2000, 100
    x = clustered(n, 16, 20, 0.05, 5)
    emb = emb_frame(spark, x, space="s")
    rows, pivots, sizes = kp.cells(emb, ["space"], "cosine", cell_rows)
    own = kp.knn_edges(rows.select("space", "cell", "w", "vec"), ["space", "cell"], 5)
    floors = own.filter("rank = 5").selectExpr("space", "i", "sim AS floor")
    shipped = kp.needed(rows, floors, pivots, sizes, ["space"]).count()
    every = n * (pivots.count() - 1)
    assert every > 10_000
    assert shipped < 0.25 * every
