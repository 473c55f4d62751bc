"""Sums and cross-products of vectors, the common input of CKA, PR, OLS and ridge.

Each task folds its own rows into small matrices and emits those, so the data itself is
never shuffled and a key that holds most rows is still summed by all tasks together.
Only matrices of (columns x columns) travel, independent of the number of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.operators.knn import _matrix

HELD_CELLS = 1 << 23


def _group_codes(batch: pa.RecordBatch, keys: list[str]):
    """(list of key tuples, code per row) for one batch."""
    if not keys:
        return [()], np.zeros(batch.num_rows, dtype=np.int64)
    table = pa.Table.from_batches([batch.select(keys)])
    table = table.append_column("__row", pa.array(np.arange(batch.num_rows)))
    groups = table.group_by(keys).aggregate([("__row", "list")])
    codes = np.empty(batch.num_rows, dtype=np.int64)
    for g, rows in enumerate(groups.column("__row_list")):
        codes[rows.values.to_numpy()] = g
    tuples = list(zip(*(groups.column(k).to_pylist() for k in keys)))
    return tuples, codes


def cross_products(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Per key and cell (f, g): s = sum of left_f * right_g, sx and sy = the two sums, n rows.

    Every cell carries what centring it needs, so nothing has to be joined back.
    """
    keys = list(keys)
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[c] for c in keys] + [
        T.StructField("f", T.IntegerType()), T.StructField("n", T.DoubleType()),
        T.StructField("sx", T.DoubleType()), T.StructField("s", doubles),
        T.StructField("sy", doubles)])
    arrow_types = {}

    def lists(m):
        offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))

    def flush(held):
        for key, m in held.items():
            rows = m.shape[0] - 1
            cols = [pa.array([v] * rows, type=arrow_types[c]) for v, c in zip(key, keys)]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(np.arange(1, rows + 1, dtype=np.int32)),
                        pa.array(np.full(rows, m[0, 0])), pa.array(m[1:, 0]),
                        lists(m[1:, 1:]), lists(np.tile(m[0, 1:], (rows, 1)))],
                names=keys + ["f", "n", "sx", "s", "sy"])

    def fold(batches):
        held, cells = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for c in keys:
                arrow_types[c] = batch.schema.field(c).type
            x = _matrix(batch.column(batch.schema.get_field_index("__left")))
            y = _matrix(batch.column(batch.schema.get_field_index("__right")))
            one = np.ones((batch.num_rows, 1))
            x, y = np.hstack([one, x]), np.hstack([one, y])
            tuples, codes = _group_codes(batch, keys)
            for g, key in enumerate(tuples):
                at = codes == g
                m = x[at].T @ y[at]
                if key in held:
                    held[key] += m
                else:
                    held[key] = m
                    cells += m.size
            if cells > HELD_CELLS:
                yield from flush(held)
                held, cells = {}, 0
        yield from flush(held)

    partial = (df.select(*keys, F.col(left).alias("__left"), F.col(right).alias("__right"))
               .mapInArrow(fold, schema))
    return (partial.select(*keys, "f", "n", "sx", F.posexplode(F.arrays_zip("s", "sy"))
                           .alias("g", "cell"))
            .groupBy(*keys, "f", (F.col("g") + 1).alias("g"))
            .agg(F.sum("cell.s").alias("s"), F.sum("sx").alias("sx"),
                 F.sum("cell.sy").alias("sy"), F.sum("n").alias("n")))


def centred() -> Column:
    """One cell of the centred cross-product matrix."""
    return F.col("s") - F.col("sx") * F.col("sy") / F.col("n")


def centred_square_norm(products: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Squared Frobenius norm of the centred cross-product matrix, per key."""
    return products.groupBy(*keys).agg(F.sum(centred() * centred()).alias(name))


def moment_matrix(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row per key: n, the sums and the D x D cross-products, for solves in that space.

    The arrays hold D and D^2 numbers in row order: bounded by the number of columns.
    """
    cells = cross_products(df, keys, vec, vec)
    held = F.array_sort(F.collect_list(F.struct("f", "g", "s", "sx")))
    return (cells.groupBy(*keys).agg(F.max("n").alias("n"), held.alias("cells"))
            .select(*keys, "n",
                    F.transform(F.filter("cells", lambda c: c["g"] == 1), lambda c: c["sx"])
                    .alias("total"),
                    F.transform("cells", lambda c: c["s"]).alias("products")))


def augmented(n: float, total, products) -> np.ndarray:
    """The matrix of [1, x]^T [1, x] from one row of :func:`moment_matrix`."""
    total = np.asarray(total, dtype=np.float64)
    d = len(total)
    m = np.empty((d + 1, d + 1))
    m[0, 0], m[0, 1:], m[1:, 0] = n, total, total
    m[1:, 1:] = np.asarray(products, dtype=np.float64).reshape(d, d)
    return m
