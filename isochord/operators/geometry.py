"""Intrinsic dimension and spectrum of a space."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.operators.knn import knn_edges
from isochord.operators.moments import augmented, centred, cross_products, moment_matrix
from isochord.operators.ordered import by_ratio, running, value_counts


def participation_ratio(emb: DataFrame, keys: list[str]) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squares, from trace and Frobenius norm alone."""
    c = centred()
    trace = F.sum(F.when(F.col("f") == F.col("g"), c))
    return cross_products(emb, keys, "vec", "vec").groupBy(*keys).agg(
        (trace * trace / (F.sum(c * c) + F.lit(1e-12))).alias("participation_ratio"))


def spectrum_stats(emb: DataFrame, keys: list[str], n_top: int = 64) -> DataFrame:
    """Participation ratio, effective rank and the normalised top eigenvalues.

    Only the D x D moment matrix of each key is decomposed.
    """
    m = moment_matrix(emb, keys, "vec")
    schema = T.StructType([m.schema[c] for c in keys] + [
        T.StructField("participation_ratio", T.DoubleType()),
        T.StructField("effective_rank", T.DoubleType()),
        T.StructField("eigenspectrum", T.ArrayType(T.DoubleType()))])

    def decompose(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                full = augmented(row.n, row.total, row.products)
                cov = full[1:, 1:] - np.outer(full[0, 1:], full[0, 1:]) / row.n
                ev = np.sort(np.linalg.eigvalsh(cov).clip(min=0))[::-1]
                s = ev.sum()
                share = ev / s if s > 0 else ev
                p = share[share > 0]
                top = [None] * n_top
                top[:min(n_top, len(ev))] = share[:n_top].tolist()
                rows.append((s * s / (np.square(ev).sum() + 1e-12),
                             float(np.exp(-(p * np.log(p)).sum())) if s > 0 else None, top))
            out = pd.DataFrame(rows, columns=["participation_ratio", "effective_rank",
                                              "eigenspectrum"])
            yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)

    return m.mapInPandas(decompose, schema)


def twonn_id(emb: DataFrame, keys: list[str], keep_percent: int = 90,
             n_windows: int | None = None) -> DataFrame:
    """Dimension from the ratio of second to first neighbour distance.

    Slope, with intercept, of -log(1 - F) on log(ratio) over the lowest ``keep_percent``
    of ratios above one; F uses the number kept.
    """
    d = -F.col("sim")
    ratio = (knn_edges(emb, keys, k=2, metric="euclidean", n_windows=n_windows)
             .groupBy(*keys, "i").agg(F.max(F.when(F.col("rank") == 1, d)).alias("r1"),
                                      F.max(F.when(F.col("rank") == 2, d)).alias("r2"))
             .withColumn("mu", F.col("r2") / F.greatest("r1", F.lit(1e-12)))
             .filter(F.col("mu") > 1.0 + 1e-12))
    run = running(value_counts(ratio, keys, "mu"), keys, "mu", {"cum": "n"}, by_ratio)
    kept = F.greatest((F.col("cum_all") * keep_percent / 100).cast("bigint"),
                      F.lit(4).cast("bigint"))
    places = (run.filter("cum_all >= 4").withColumn("kept", F.least(kept, F.col("cum_all")))
              .withColumn("place", F.explode(F.sequence(F.col("cum") - F.col("n") + 1,
                                                        F.col("cum"))))
              .filter(F.col("place") <= F.col("kept")))
    y = -F.log(1 - F.col("place") / (F.col("kept") + 1))
    return places.groupBy(*keys).agg(
        F.regr_slope(y, F.log("mu")).alias("twonn_id"), F.max("kept").alias("n_kept"))


def mle_id(emb: DataFrame, keys: list[str], k1: int = 10, k2: int = 20,
           n_windows: int | None = None) -> DataFrame:
    """Maximum-likelihood dimension, averaged over neighbourhood sizes k1..k2."""
    by_point = Window.partitionBy(*keys, "i").orderBy("rank")
    before = by_point.rowsBetween(Window.unboundedPreceding, -1)
    logs = (knn_edges(emb, keys, k=k2, metric="euclidean", n_windows=n_windows)
            .withColumn("log_d", F.log(F.greatest(-F.col("sim"), F.lit(1e-12))))
            .withColumn("below", F.sum("log_d").over(before))
            .filter(F.col("rank") >= k1))
    per_k = logs.groupBy(*keys, "rank").agg(
        F.avg(F.col("log_d") - F.col("below") / (F.col("rank") - 1)).alias("inv"))
    inv = F.avg("inv")
    return per_k.groupBy(*keys).agg(F.when(inv > 0, 1 / inv).alias("mle_id"))


def _local_dims(x: np.ndarray, keep: float = 0.9) -> np.ndarray:
    """TwoNN of many small neighbourhoods ``[group, point, feature]`` at once.

    Ratios that don't exceed one sort to the end and have no weight in the regression.
    """
    groups, points, _ = x.shape
    if points < 4:
        return np.full(groups, np.nan)
    gap = np.square(x[:, :, None, :] - x[:, None, :, :]).sum(axis=-1)
    gap[:, np.arange(points), np.arange(points)] = np.inf
    pair = np.sqrt(np.partition(gap, 1, axis=2)[:, :, :2])
    ratio = pair[:, :, 1] / np.maximum(pair[:, :, 0], 1e-12)
    ratio = np.sort(np.where(ratio > 1.0 + 1e-12, ratio, np.inf), axis=1)
    usable = np.isfinite(ratio).sum(axis=1)
    kept = np.minimum(np.maximum((usable * keep).astype(int), 4), usable)[:, None]
    place = np.arange(1, points + 1)[None, :]
    weight = (place <= kept).astype(float)
    u = np.where(weight > 0, np.log(np.where(np.isfinite(ratio), ratio, 1.0)), 0.0)
    v = np.where(weight > 0, -np.log1p(-np.minimum(place / (kept + 1), 0.999999)), 0.0)
    n = weight.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mu, mv = u.sum(axis=1) / n, v.sum(axis=1) / n
        du = weight * (u - mu[:, None])
        slope = (du * (v - mv[:, None])).sum(axis=1) / (du * du).sum(axis=1)
    return np.where(usable >= 4, slope, np.nan)


def local_twonn(emb: DataFrame, keys: list[str], k: int = 20,
                n_windows: int | None = None) -> DataFrame:
    """TwoNN inside every point's cosine neighbourhood (the point itself left out)."""
    edges = knn_edges(emb, keys, k=k, n_windows=n_windows)
    points = emb.select(*keys, F.col("w").alias("j"), "vec")
    near = (edges.join(points, [*keys, "j"]).groupBy(*keys, "i")
            .agg(F.collect_list("vec").alias("near")))
    schema = T.StructType([near.schema[c] for c in [*keys, "i"]]
                          + [T.StructField("local_id", T.DoubleType())])

    def estimate(batches):
        for pdf in batches:
            sizes = pdf["near"].map(len)
            dims = pd.Series(np.nan, index=pdf.index)
            for size, at in sizes.groupby(sizes).groups.items():
                # slices bound the pairwise differences that are held at once
                for lo in range(0, len(at), 64):
                    part = at[lo:lo + 64]
                    x = np.stack([np.stack(v) for v in pdf.loc[part, "near"]]).astype(float)
                    x /= np.linalg.norm(x, axis=2, keepdims=True) + 1e-12
                    dims[part] = _local_dims(x)
            yield pdf[[*keys, "i"]].assign(local_id=dims.where(dims.notna(), None).astype(float))

    return near.mapInPandas(estimate, schema)
