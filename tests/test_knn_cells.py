"""Searches cell by cell find what a comparison of all pairs finds, with far fewer products."""

import numpy as np
import pytest

from helpers import emb_frame
from isochord.operators import knn, knn_cells
from isochord.plans import alignment, nulls

DRAW = {
    "plain": lambda rng, x: x,
    "copies": lambda rng, x: np.where((np.arange(len(x)) % 3 == 0)[:, None], x[0], x),
    "near": lambda rng, x: np.where((np.arange(len(x)) % 3 == 0)[:, None],
                                    x[0] + rng.normal(0, 1e-4, x.shape), x),
    "zeros and tiny": lambda rng, x: x * np.select(
        [np.arange(len(x)) % 5 == 0, np.arange(len(x)) % 7 == 0], [0.0, 1e-11], 1.0)[:, None],
    "smooth": lambda rng, x: np.cumsum(x, axis=0),
    "one side": lambda rng, x: x + 9,
    "opposite": lambda rng, x: np.where((np.arange(len(x)) % 2 == 0)[:, None], 1, -1)
    * (x[0] + rng.normal(0, 1e-3, x.shape)),
}


@pytest.mark.parametrize("kind", DRAW)
@pytest.mark.parametrize("excl,k,twice", [(0, 5, False), (6, 5, False), (0, 40, True)])
def test_cells_find_what_double_precision_finds(kind, excl, k, twice, monkeypatch):
    monkeypatch.setattr(knn, "CELLS_FROM", 100)
    monkeypatch.setattr(knn_cells, "CELL_ROWS", 40)
    monkeypatch.setattr(knn_cells, "TRIED", 50)
    monkeypatch.setattr(knn_cells, "BATCH", 2000)
    monkeypatch.setattr(knn_cells, "WORTH", 2.0)
    rng = np.random.default_rng(3)
    x = DRAW[kind](rng, rng.normal(size=(3000, 6)))
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    w = rng.permutation(len(x)) // (2 if twice else 1)
    q, o, s, p = knn._best(x[:700], w[:700], x, w, k, excl, "cosine")
    dq, do, ds, dp = knn._dense(x[:700], w[:700], x, w, k, excl, "cosine")
    assert (q == dq).all() and (w[o] == w[do]).all() and (p == dp).all()
    assert np.abs(s - ds).max() < 1e-11


def test_products_grow_far_less_than_pairs(monkeypatch):
    """Before, every pair of windows was multiplied: four times the windows, sixteen times the work."""
    rng = np.random.default_rng(4)

    def work(n):
        x = rng.normal(size=(n, 8))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x32, w = x.astype(np.float32), np.arange(n)
        cells = knn_cells.dealt(x32, knn_cells.is_unit(x), 1e-6)
        products = []

        class Counted(np.ndarray):
            def __matmul__(self, other):
                out = np.asarray(self) @ np.asarray(other)
                products.append(out.size)
                return out
        q, _ = knn_cells.candidates(x32[:2000], cells._replace(rows=cells.rows.view(Counted)),
                                    w[:2000], w[:2000] + 1, 5, 1e-6)
        assert (np.bincount(q) >= 5).all()
        return sum(products) / 2000
    few, many = work(6000), work(24000)
    assert many < 0.25 * 24000 and many < 3 * few


def test_many_dimensions_are_compared_without_cells(monkeypatch):
    monkeypatch.setattr(knn, "CELLS_FROM", 100)
    tried = []
    search = knn_cells.candidates
    monkeypatch.setattr(knn_cells, "candidates",
                        lambda *a: tried.append((len(a[0]), search(*a))) or tried[-1][1])
    x = np.random.default_rng(5).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.arange(len(x))
    q, o, _, _ = knn._best(x, w, x, w, 5, 0, "cosine")
    assert tried == [(knn_cells.TRIED, None)]
    assert (o[q < 50] == knn._dense(x[:50], w[:50], x, w, 5, 0, "cosine")[1]).all()


def test_blocks_searched_by_cells_make_the_whole_graph(spark, monkeypatch):
    """Two spaces of several blocks, with vectors missing in part."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 3))
    x[::50] = 0
    e = emb_frame(spark, x, m="x")
    rows = knn.knn_edges(e, ["m"], 3, block_rows=4500, n_windows=len(x)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], {})[r["rank"]] = r["j"]
    z = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    at = np.arange(len(x))
    q, o, _, p = knn._dense(z, at, z, at, 3, 0, "cosine")
    assert {i: [got[i][n] for n in (1, 2, 3)] for i in got} == {i: list(o[q == i]) for i in at}


MODEL_QUERIES = {
    "model_pair_curves": (alignment, "model_pair_curves"),
    "calibrate_model_pairs": (alignment, "calibrate_model_pairs"),
    "excess_null": (alignment, "excess_null"),
    "family_mean_z": (alignment, "family_mean_z"),
    "cross_family_mean": (nulls, "cross_family_mean"),
    "partner_family_mean": (nulls, "partner_family_mean"),
    "intramodal_partner": (nulls, "intramodal_partner"),
    "centre_within_family": (nulls, "centre_within_family"),
}


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_queries_of_a_long_recording(spark, tmp_path, monkeypatch, name):
    """Before, recordings of more than one segment failed with an ambiguous column."""
    x = np.random.default_rng(13).normal(size=(260, 64))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                          "vec_id bigint, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    query = getattr(*MODEL_QUERIES[name])
    short = sorted(query(spark, str(tmp_path)).collect())
    monkeypatch.setattr(alignment.shift_curve, "SEGMENT", 64)
    monkeypatch.setattr(alignment.shift_curve.shift_counts, "__defaults__", (None, 64, 2))
    assert sorted(query(spark, str(tmp_path)).collect()) == short and short
