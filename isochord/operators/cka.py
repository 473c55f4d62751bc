"""Linear CKA at chosen rotations and at all rotations.

For centred X and Y the Gram inner product equals the squared Frobenius norm of the
cross-covariance, so CKA needs sums over windows only. At all rotations that norm is the
sum, over feature pairs, of the squared circular cross-correlation of two series; feature
series are transformed once and then met tile by tile, which spreads the work over
(layer pair, feature block, feature block) and never builds a window-by-window matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.functions.vectors import modulo
from isochord.operators.knn import _matrix
from isochord.operators.moments import (augmented, centred_square_norm, cross_products,
                                        moment_matrix)


SALT = 8


def feature_block_for(n_windows: int) -> int:
    """Features kept together: about two million numbers, so long series travel singly."""
    return max(1, min(16, (1 << 21) // n_windows))


def self_norm(emb: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Frobenius norm of the centred Gram matrix of each space."""
    sq = centred_square_norm(cross_products(emb, keys, "vec", "vec"), keys, name)
    return sq.withColumn(name, F.sqrt(name))


def cka_at_shifts(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
                  on: list[str], n_windows: int, shifts: list[int]) -> DataFrame:
    """CKA with b rotated by each d: b's window p then sits at (p + d) mod W."""
    rotated = (b.select(*on, *b_keys, F.col("vec").alias("vec_b"), "w",
                        F.explode(F.array(*[F.lit(int(s)) for s in shifts])).alias("shift"))
               .withColumn("w", modulo(F.col("w") + F.col("shift"), n_windows)))
    both = a.select(*on, *a_keys, "w", F.col("vec").alias("vec_a")).join(rotated, [*on, "w"])
    keys = [*on, *a_keys, *b_keys, "shift"]
    cross = centred_square_norm(cross_products(both, keys, "vec_a", "vec_b"), keys, "cross")
    return (cross.join(self_norm(a, [*on, *a_keys], "norm_a"), [*on, *a_keys])
            .join(self_norm(b, [*on, *b_keys], "norm_b"), [*on, *b_keys])
            .select(*keys, (F.col("cross") / (F.col("norm_a") * F.col("norm_b")
                                              + F.lit(1e-20))).alias("cka")))


def spectra(emb: DataFrame, keys: list[str], n_windows: int,
            feature_block: int) -> DataFrame:
    """Transformed, centred feature series: one row per (keys, feature block)."""
    blocks = F.sequence(F.lit(0), F.floor((F.size("vec") - 1) / feature_block).cast("int"))
    cut = (emb.select(*keys, "w", "vec", F.explode(blocks).alias("fb"))
           .select(*keys, "fb", F.col("w").cast("bigint").alias("w"),
                   F.slice("vec", F.col("fb") * feature_block + 1,
                           F.lit(feature_block)).alias("part")))
    schema = T.StructType([cut.schema[c] for c in keys]
                          + [T.StructField("fb", T.IntegerType()),
                             T.StructField("n_features", T.IntegerType()),
                             T.StructField("spectrum", T.BinaryType())])
    names = list(keys)

    def transform(key, table):
        x = np.zeros((n_windows, len(table.column("part")[0])))
        # centred over the windows that are there; absent ones add nothing to any product
        part = _matrix(table.column("part"))
        x[table.column("w").to_numpy()] = part - part.mean(axis=0, keepdims=True)
        spec = np.fft.rfft(x, axis=0).T.copy()
        cols = [pa.array([k.as_py()], type=k.type) for k in key]
        return pa.table(cols + [pa.array([x.shape[1]], type=pa.int32()),
                                pa.array([spec.tobytes()], type=pa.binary())],
                        names=names + ["fb", "n_features", "spectrum"])

    return cut.groupBy(*names, "fb").applyInArrow(transform, schema)


def cka_all_shifts(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
                   on: list[str], n_windows: int,
                   feature_block: int | None = None) -> DataFrame:
    """CKA at every rotation d = 0..W-1."""
    feature_block = feature_block or feature_block_for(n_windows)
    keys = [*on, *a_keys, *b_keys]
    sa, sb = (spectra(x, [*on, *k], n_windows, feature_block)
              .withColumnsRenamed({"fb": f"fb_{s}", "n_features": f"n_{s}",
                                   "spectrum": f"spec_{s}"})
              for x, k, s in ((a, a_keys, "a"), (b, b_keys, "b")))
    # spaces of one grid all meet each other: spread the meeting over SALT x SALT cells
    mine = {x: F.pmod(F.xxhash64(*k, f"fb_{x}"), F.lit(SALT)).cast("int")
            for x, k in (("a", a_keys), ("b", b_keys))}
    every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    sa = sa.withColumn("salt_a", mine["a"]).withColumn("salt_b", every)
    sb = sb.withColumn("salt_b", mine["b"]).withColumn("salt_a", every)
    tiles = sa.join(sb, [*on, "salt_a", "salt_b"]).drop("salt_a", "salt_b")
    schema = T.StructType([tiles.schema[c] for c in keys]
                          + [T.StructField("d", T.LongType()),
                             T.StructField("v", T.DoubleType())])

    def correlate(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.spec_a, np.complex128).reshape(row.n_a, -1)
                y = np.conj(np.frombuffer(row.spec_b, np.complex128).reshape(row.n_b, -1))
                total = np.zeros(n_windows)
                for f in range(row.n_a):
                    total += np.square(np.fft.irfft(x[f][None, :] * y, n=n_windows,
                                                    axis=1)).sum(axis=0)
                out = {name: getattr(row, name) for name in keys}
                yield pd.DataFrame({**out, "d": np.arange(n_windows), "v": total})

    squared = (tiles.mapInPandas(correlate, schema).groupBy(*keys, "d")
               .agg(F.sum("v").alias("cross")))
    return (squared.join(self_norm(a, [*on, *a_keys], "norm_a"), [*on, *a_keys])
            .join(self_norm(b, [*on, *b_keys], "norm_b"), [*on, *b_keys])
            .select(*keys, "d", (F.col("cross") / (F.col("norm_a") * F.col("norm_b")
                                                   + F.lit(1e-20))).alias("score")))


def cka_without_top(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
                    on: list[str], n_windows: int, shifts: list[int],
                    ranks: list[int]) -> DataFrame:
    """CKA after removing the r strongest principal directions of either side.

    Removing directions only changes the D x D moment matrices, so one pass over the
    windows serves every r.
    """
    keys = [*on, *a_keys, *b_keys, "shift"]
    rotated = (b.select(*on, *b_keys, F.col("vec").alias("vec_b"), "w",
                        F.explode(F.array(*[F.lit(int(s)) for s in shifts])).alias("shift"))
               .withColumn("w", modulo(F.col("w") + F.col("shift"), n_windows)))
    both = (a.select(*on, *a_keys, "w", F.col("vec").alias("vec_a")).join(rotated, [*on, "w"])
            .select(*keys, F.concat("vec_a", "vec_b").alias("vec"), F.size("vec_a").alias("dim")))
    m = moment_matrix(both, [*keys, "dim"], "vec")
    schema = T.StructType([m.schema[c] for c in keys]
                          + [T.StructField("r", T.IntegerType()),
                             T.StructField("cka", T.DoubleType())])

    def deflated(cov, r):
        """Projection away from the r leading eigenvectors."""
        vec = np.linalg.eigh(cov)[1][:, ::-1][:, :r]
        return np.eye(len(cov)) - vec @ vec.T

    def solve(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                full = augmented(row.n, row.total, row.products)
                cov = full[1:, 1:] - np.outer(full[0, 1:], full[0, 1:]) / row.n
                x, y = slice(0, row.dim), slice(row.dim, None)
                values = []
                for r in ranks:
                    px, py = deflated(cov[x, x], r), deflated(cov[y, y], r)
                    norms = [np.linalg.norm(p @ cov[s, s] @ p) for p, s in ((px, x), (py, y))]
                    values.append(np.linalg.norm(px @ cov[x, y] @ py) ** 2
                                  / (norms[0] * norms[1] + 1e-20))
                out = {name: getattr(row, name) for name in keys}
                yield pd.DataFrame({**out, "r": ranks, "cka": values})

    return m.mapInPandas(solve, schema)
