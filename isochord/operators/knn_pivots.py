"""Exact k-nearest neighbours that skip what the triangle inequality rules out.

A space is cut into cells around sampled pivots. Each window first searches its own cell; the
k-th similarity found there is a floor that other cells must be able to beat. A cell with pivot p
and radius r holds nothing nearer to a window q than d(q, p) - r, so only cells whose bound reaches the
floor can matter to q. Neighbouring cells form regions, a bounded number in a space, and q is sent
once to every region that has such a cell: rows travel at most once for each region however
little the bounds exclude. The result equals that of comparing everything.

Regions of any size are searched in parts of bounded size, and so are the windows sent to one region,
so that a third of all rows in one region (copies of one vector, say) is spread over tasks. On data
without clusters nearly all pairs are needed, and the work is that of ``knn_edges``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.operators.knn import _best, _matrix, knn_edges
from isochord.operators.ordered import attach, merged
from isochord.session import written

#: Rows of a cell wanted, pivots of a space at most, rows of one step of assignment or search.
CELL_ROWS, MOST_PIVOTS, STEP_ROWS = 2048, 4096, 16384
#: Regions of a space at most; steps of rows that a task searches with or in.
REGIONS, TURN = 24, 4
#: Margin of distances from rounded squares, and of similarities that may tie once rounded.
NEAR, SLACK = 1e-7, 1e-10


def _scaled(vec: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose Euclidean distance orders like the metric; at most of length 1 for cosine."""
    if metric == "cosine":
        return vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-12)
    return vec


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p) - 2.0 * (x @ p.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _similarity_bound(distance: np.ndarray, metric: str) -> np.ndarray:
    """No pair at least this far apart is more similar."""
    far = np.maximum(distance - NEAR * (1 + np.abs(distance)), 0.0)
    return 1.0 - far * far / 2 if metric == "cosine" else -far


def _chunked(pivots: DataFrame, names: list[str], sizes: DataFrame) -> DataFrame:
    """Pivot rows once for every chunk of their space."""
    return attach(pivots, sizes.select(*names, "chunks"), names).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def cells(emb: DataFrame, keys: list[str], metric: str = "cosine", cell_rows: int = CELL_ROWS
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pivots, sizes): rows with the cell of their nearest pivot (named by its window) and
    the distance to it; pivots with radius and rows of their cell; rows per space."""
    names = list(keys)
    emb = emb.select(*names, F.col("w").cast("bigint").alias("w"), "vec")
    n = F.count(F.lit(1))
    sizes = written(emb.groupBy(*names).agg(
        n.alias("n"), F.min("w").alias("first"),
        F.ceil(n / STEP_ROWS).cast("int").alias("chunks"),
        F.greatest(F.lit(1), F.floor(n / F.least(F.lit(MOST_PIVOTS), F.ceil(n / cell_rows))))
        .alias("step")), "sizes")
    sized = attach(emb, sizes, names)
    chosen = (F.pmod(F.xxhash64("w"), F.col("step")) == 0) | (F.col("w") == F.col("first"))
    pivots = sized.filter(chosen).select(*names, F.col("w").alias("cell"),
                                         F.col("vec").alias("pivot"))
    pivots = written(pivots.dropDuplicates([*names, "cell"]), "pivots")

    schema = T.StructType([*(emb.schema[c] for c in [*names, "w", "vec"]),
                           T.StructField("cell", T.LongType()),
                           T.StructField("far", T.DoubleType())])

    def assign(key: tuple, mine: pa.Table, given: pa.Table) -> pa.Table:
        p = _scaled(_matrix(given.column("pivot")), metric)
        order = np.argsort(given.column("cell").to_numpy())
        of = given.column("cell").to_numpy()[order]
        x = _scaled(_matrix(mine.column("vec")), metric)
        best, far = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 1024):
            d = _distances(x[at:at + 1024], p[order])
            best[at:at + 1024], far[at:at + 1024] = of[d.argmin(1)], d.min(1)
        return pa.table([*(mine.column(c) for c in [*names, "w", "vec"]), pa.array(best),
                         pa.array(far)], schema.names)

    rows = sized.withColumn("chunk", F.pmod(F.xxhash64("w", F.lit(1)), F.col("chunks")).cast("int"))
    rows = written(rows.select(*names, "w", "vec", "chunk").groupBy(*names, "chunk")
                   .cogroup(_chunked(pivots, names, sizes).groupBy(*names, "chunk"))
                   .applyInArrow(assign, schema), "cells")
    stats = rows.groupBy(*names, "cell").agg(F.max("far").alias("radius"), n.alias("n"))
    return rows, written(with_regions(pivots.join(stats, [*names, "cell"]), names, metric),
                         "pivots"), sizes


def with_regions(pivots: DataFrame, names: list[str], metric: str) -> DataFrame:
    """Pivots (at most a few thousand a space) with the region of their cell: that of the nearest of
    a few of them, as many as there are steps of rows."""
    schema = T.StructType([*pivots.schema.fields, T.StructField("region", T.LongType())])

    def near(key: tuple, table: pa.Table) -> pa.Table:
        p, cell = _scaled(_matrix(table.column("pivot")), metric), table.column("cell").to_numpy()
        wanted = min(REGIONS, -(-int(table.column("n").to_numpy().sum()) // STEP_ROWS))
        heads = np.argsort(cell)[np.linspace(0, len(cell) - 1, wanted).astype(int)]
        return table.append_column("region", pa.array(cell[heads][
            _distances(p, p[heads]).argmin(1)]))

    return pivots.groupBy(*names).applyInArrow(near, schema)


def needed(rows: DataFrame, floors: DataFrame, pivots: DataFrame, sizes: DataFrame,
           keys: list[str], metric: str = "cosine") -> DataFrame:
    """(keys, w, region): the regions with another cell that may hold a neighbour of a window.
    ``floors`` (keys, i, floor) has the k-th similarity found so far; windows without one need every
    cell."""
    names = list(keys)
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("w", T.LongType()),
                           T.StructField("region", T.LongType())])

    def among(key: tuple, mine: pa.Table, given: pa.Table) -> pa.Table:
        p, of = _scaled(_matrix(given.column("pivot")), metric), given.column("cell").to_numpy()
        order = np.argsort(given.column("region").to_numpy(), kind="stable")
        p, of, region = p[order], of[order], given.column("region").to_numpy()[order]
        first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        radius = given.column("radius").to_numpy()[order]
        w, own = mine.column("w").to_numpy(), mine.column("cell").to_numpy()
        floor = mine.column("floor").to_numpy(zero_copy_only=False).astype(float)
        x = _scaled(_matrix(mine.column("vec")), metric)
        out = [(np.empty(0, np.int64),) * 2]
        for at in range(0, len(w), 1024):
            some = slice(at, at + 1024)
            bound = _similarity_bound(_distances(x[some], p) - radius, metric)
            open_ = ~(bound < floor[some, None] - SLACK) & (own[some, None] != of)
            r, c = np.nonzero(np.logical_or.reduceat(open_, first, axis=1))
            out.append((w[some][r], region[first][c]))
        w, at = (np.concatenate(c) for c in zip(*out))
        return pa.table([*(pa.repeat(key[i], len(w)) for i in range(len(names))), pa.array(w),
                         pa.array(at)], schema.names)

    floored = attach(rows, sizes.select(*names, "chunks"), names).join(
        floors.withColumnRenamed("i", "w"), [*names, "w"], "left").select(
        *names, "w", "vec", "cell", "floor",
        F.pmod(F.xxhash64("w", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"))
    return (floored.groupBy(*names, "chunk")
            .cogroup(_chunked(pivots.select(*names, "cell", "pivot", "radius", "region"), names,
                              sizes)
                     .groupBy(*names, "chunk")).applyInArrow(among, schema))


def pruned_knn_edges(emb: DataFrame, keys: list[str], k: int = 5, excl: int = 0,
                     metric: str = "cosine", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Directed edges (keys, i, j, rank, sim), equal to those of ``knn_edges``.

    For spaces of many times ``cell_rows`` windows. ``emb`` has the key columns, ``w``, unique
    within them, and ``vec``, of one length, without NULLs. A space of no more than k windows
    gives all there are; an empty table gives no rows.
    """
    names = list(keys)
    rows, pivots, sizes = cells(emb, names, metric, cell_rows)
    own = written(knn_edges(rows.select(*names, "cell", "w", "vec"), [*names, "cell"], k, excl,
                            metric).drop("cell"), "own")
    floors = own.filter(F.col("rank") == k).select(*names, "i", F.col("sim").alias("floor"))
    need = written(needed(rows, floors, pivots, sizes, names, metric), "needed")
    asked = need.groupBy(*names, "region").agg(
        F.ceil(F.count(F.lit(1)) / (TURN * STEP_ROWS)).cast("int").alias("turns"))
    parts = written(asked.join(pivots.groupBy(*names, "region").agg(
        F.ceil(F.sum("n") / (TURN * STEP_ROWS)).cast("int").alias("parts")), [*names, "region"]), "parts")
    rows = rows.join(pivots.select(*names, "cell", "region"), [*names, "cell"])

    def dealt(df: DataFrame, own: str, other: str, asks: bool, seed: int) -> DataFrame:
        """Rows in one part of their side, once for each part of the other."""
        return (df.join(parts, [*names, "region"])
                .withColumn(own, F.pmod(F.xxhash64("w", F.lit(seed)), F.col(f"{own}s")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
                .select(*names, "region", "part", "turn", "w", "vec", "cell",
                        F.lit(asks).alias("asks")))

    asks = dealt(merged(need, rows.select(*names, "w", "vec", "cell"), [*names, "w"]), "turn", "part",
                 True, 2)
    gives = dealt(rows, "part", "turn", False, 3)
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("i", T.LongType()),
                           T.StructField("j", T.LongType()), T.StructField("sim", T.DoubleType())])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        ask = table.column("asks").to_numpy(zero_copy_only=False)
        w, vec = table.column("w").to_numpy(), _scaled(_matrix(table.column("vec")), metric)
        i = j = np.empty(0, np.int64)
        sim = np.empty(0)
        if ask.any() and not ask.all():
            q, o, sim, _ = _best(vec[ask], w[ask], vec[~ask], w[~ask], k, excl, metric)
            cell = table.column("cell").to_numpy()
            new = cell[ask][q] != cell[~ask][o]     # those of its own cell a window has already
            i, j, sim = w[ask][q[new]], w[~ask][o[new]], sim[new]
        return pa.table([*(pa.repeat(key[n], len(i)) for n in range(len(names))), pa.array(i),
                         pa.array(j), pa.array(sim)], schema.names)

    # tasks take far more time than their bytes suggest: their number is kept
    n_tasks = max(REGIONS * 16, int(emb.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    far = (asks.unionByName(gives).repartition(n_tasks, *names, "region", "part", "turn")
           .groupBy(*names, "region", "part", "turn").applyInArrow(search, schema))
    by_window = Window.partitionBy(*names, "i").orderBy(F.col("sim").desc(), "j")
    return (own.select(*names, "i", "j", "sim").unionByName(far)
            .withColumn("rank", F.row_number().over(by_window)).filter(F.col("rank") <= k))
