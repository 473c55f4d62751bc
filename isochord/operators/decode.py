"""Linear decodability: cross-validated ridge R^2 of window features from an embedding.

Ridge needs the data only through sums and cross-products, per contiguous fold. Those are
folded by every map task (see ``moments``); the solve then works on matrices of the size of
the embedding, one small task per key, whatever the number of windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.functions.vectors import l2, missing_to_null
from isochord.operators.moments import augmented, moment_matrix

# Penalties and fold count.
ALPHAS = np.logspace(-1, 4, 10)
N_FOLDS = 5


def fold_bounds(n_windows: int, n_folds: int = N_FOLDS) -> list[int]:
    """First window of every fold, then the end: W*f/n_folds truncated."""
    return [int(x) for x in np.linspace(0, n_windows, n_folds + 1)]


def fold_of(w: Column, n_windows: int, n_folds: int = N_FOLDS) -> Column:
    inner = F.array(*[F.lit(b) for b in fold_bounds(n_windows, n_folds)[1:-1]])
    return F.size(F.filter(inner, lambda b: b <= w))


def clean_features(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Missing or non-finite entries take the column mean of their key, else 0."""
    d = features.select(*[c for c in features.columns if c not in names],
                        *[missing_to_null(F.col(n).cast("double")).alias(n) for n in names])
    means = d.groupBy(*keys).agg(*[F.avg(n).alias(f"__m_{n}") for n in names])
    j = d.join(means, keys) if keys else d.join(F.broadcast(means))
    return j.select(*[c for c in d.columns if c not in names],
                    *[F.coalesce(n, f"__m_{n}", F.lit(0.0)).alias(n) for n in names])


def _split(m: np.ndarray, dim: int):
    """Count, sums and cross-products of x and y from one augmented moment matrix."""
    x, y = slice(1, dim + 1), slice(dim + 1, None)
    return m[0, 0], m[0, x], m[0, y], m[x, x], m[x, y], np.diag(m[y, y])


def ridge_from_moments(folds: list[np.ndarray], dim: int, alphas=ALPHAS) -> np.ndarray:
    """Best mean-fold R^2 per target from per-fold moments; NaN where unfittable."""
    total = sum(folds)
    n_targets = total.shape[0] - 1 - dim
    acc, n_ok = np.zeros((len(alphas), n_targets)), np.zeros(n_targets)
    for test in folds:
        n_te, sx_te, sy_te, xx_te, xy_te, yy_te = _split(test, dim)
        n, sx, sy, xx, xy, _ = _split(total - test, dim)
        if n_te < 3 or n < 5:
            continue
        mu, ym = sx / n, sy / n
        sd = np.sqrt(np.maximum(np.diag(xx) / n - mu * mu, 0.0)) + 1e-8
        gram = (xx - n * np.outer(mu, mu)) / np.outer(sd, sd)
        target = (xy - n * np.outer(mu, ym)) / sd[:, None]
        ev, vec = np.linalg.eigh(gram)
        rotated = vec.T @ target
        # test block, standardised with the training statistics
        z_sum = (sx_te - n_te * mu) / sd
        zz = (xx_te - np.outer(sx_te, mu) - np.outer(mu, sx_te)
              + n_te * np.outer(mu, mu)) / np.outer(sd, sd)
        zy = (xy_te - np.outer(mu, sy_te)) / sd[:, None] - np.outer(z_sum, ym)
        rr = yy_te - 2 * ym * sy_te + n_te * ym * ym
        y_var = np.maximum(yy_te / n_te - (sy_te / n_te) ** 2, 0.0)
        valid = y_var > 1e-9
        ss_tot = y_var * n_te + 1e-12
        n_ok += valid
        for a, alpha in enumerate(alphas):
            beta = vec @ (rotated / (np.maximum(ev, 0.0) + alpha)[:, None])
            sse = rr - 2 * (beta * zy).sum(0) + np.einsum("if,ij,jf->f", beta, zz, beta)
            acc[a] += np.where(valid, np.clip(1.0 - sse / ss_tot, -10.0, 1.0), 0.0)
    n_all, _, sy, _, _, yy = _split(total, dim)
    g_var = yy / n_all - (sy / n_all) ** 2
    best = (acc / np.where(n_ok > 0, n_ok, np.nan)).max(0)
    return np.where((n_ok > 0) & (g_var > 1e-9), best, np.nan)


def ridge_r2(emb: DataFrame, features: DataFrame, keys: list[str], feature_keys: list[str],
             names: list[str], n_windows: int) -> DataFrame:
    """(keys, feature, r2): embeddings meet their window's features, then moments, then solve."""
    x = emb.select(*keys, "w", l2(F.col("vec").cast("array<double>")).alias("x"))
    y = features.select(*feature_keys, "w", F.array(*names).alias("y"))
    both = (x.join(y, [*feature_keys, "w"]).filter(F.col("w") < n_windows)
            .select(*keys, fold_of(F.col("w"), n_windows).alias("fold"),
                    F.concat("x", "y").alias("xy"), F.size("x").alias("dim")))
    folds = moment_matrix(both, [*keys, "dim", "fold"], "xy")
    schema = T.StructType([folds.schema[c] for c in keys]
                          + [T.StructField("feature", T.StringType()),
                             T.StructField("r2", T.DoubleType())])

    def solve(pdf):
        dim = int(pdf["dim"].iloc[0])
        mats = [augmented(row.n, row.total, row.products)
                for row in pdf.sort_values("fold").itertuples(index=False)]
        r2 = ridge_from_moments(mats, dim)
        out = {c: [pdf[c].iloc[0]] * len(names) for c in keys}
        return pd.DataFrame({**out, "feature": names,
                             "r2": pd.Series(r2).where(np.isfinite(r2), None)})

    # at most five small matrices per key
    return folds.groupBy(*keys).applyInPandas(solve, schema)


def decodability(r2: DataFrame, keys: list[str]) -> DataFrame:
    """Best layer per feature, then the mean over features; unfittable ones are left out."""
    best = r2.groupBy(*keys, "feature").agg(F.max("r2").alias("best"))
    return best.groupBy(*keys).agg(F.avg("best").alias("decodability"))
