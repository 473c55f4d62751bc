"""Exact k-nearest-neighbour graphs.

Every space (one combination of the key columns) is cut into blocks of bounded size by
a hash of the window index. One task compares one *pair of blocks* with matrix products
and keeps only its own k best per window, so neither a large space nor a large group of
copies ever sits in one task, and what is shuffled afterwards is k entries per window and
block, packed by ranges of windows, not one row per pair of windows. A block pair serves both
directions.

Products are first taken in single precision and compared with the k-th best found so far, less
a bound of their error; only what may still be among the k best is computed in double precision.
In few dimensions most products are ruled out before, cell by cell (``knn_cells``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.operators import knn_cells
from isochord.operators.knn_cells import LEAST, MOST_CANDIDATES
from isochord.operators.ordered import attach

# A task holds two blocks. Larger blocks mean fewer copies of each row in the shuffle, smaller
# ones more tasks; blocks grow with the space from the first to the second number of rows.
BLOCK_ROWS = (32768, 65536)
BLOCKS_WANTED = 12
#: Partitions for each pair of blocks of a space, windows whose candidates are merged together.
SPREAD, MERGE_WINDOWS = 4, 2048
QUERY_ROWS = 512
#: Columns of one product, and of the first one, from which the k-th best is first read.
STEP_COLS, FIRST_COLS, GROUP_COLS = 1024, 512, 16
#: Rows of a block from which cells are tried.
CELLS_FROM = 4096
#: Entries of one product in double precision, at most.
DENSE = 1 << 22
#: Relative error of a rounded single-precision number.
SINGLE = 2.0 ** -23
TIE_DIGITS = 12
SLACK = 1e-11


def _matrix(column) -> np.ndarray:
    """A list column as a dense (rows, dims) double matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _first_copies(vec: np.ndarray, w: np.ndarray, k: int, excl: int) -> np.ndarray:
    """Rows in the order of ``w``, without copies that cannot be a neighbour of any window: ties go
    to the smaller index, so of equal vectors only the first few count."""
    order = np.argsort(w, kind="stable")
    if not vec.shape[1]:
        return order
    x, sorted_w = np.ascontiguousarray(vec[order]), w[order]
    odd = np.random.default_rng(0).integers(1, 1 << 63, x.shape[1], dtype=np.uint64) | np.uint64(1)
    bits = x.view(np.uint64)
    mixed = ((bits ^ (bits >> np.uint64(29))) * odd).sum(axis=1, dtype=np.uint64)
    by = np.argsort(mixed, kind="stable")
    start = np.r_[True, mixed[by][1:] != mixed[by][:-1]]
    if start.all():
        return order
    first = np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    if (bits[by] != bits[by[first]]).any():
        return order
    most = np.diff(np.flatnonzero(np.r_[True, sorted_w[1:] != sorted_w[:-1], True])).max()
    kept = np.arange(len(by)) - first < k + most * (2 * excl + 1)
    return order[np.sort(by[kept])]


def _best(query, query_w, other, other_w, k, excl, metric):
    """Row in query, row in other, score and place (from 0) of the k best candidates."""
    finite = np.isfinite(query).all() and np.isfinite(other).all()
    rows = _first_copies(other, other_w, k, excl) if finite else np.arange(len(other_w))
    other, other_w = other[rows], other_w[rows]
    out = [(np.empty(0, np.int64),) * 2 + (np.empty(0), np.empty(0, np.int64))]
    if finite and metric == "cosine" and len(rows) > 2 * max(FIRST_COLS, 8 * k):
        q32, o32 = query.astype(np.float32), other.astype(np.float32)
        longest = np.prod([np.sqrt(np.einsum("ij,ij->i", x, x).max()) for x in (query, other)])
        margin = 2 * (query.shape[1] + 4) * SINGLE * longest + SLACK
        low = np.searchsorted(other_w, query_w - excl, "left")
        high = np.searchsorted(other_w, query_w + excl, "right")

        def settled(at, q, o):
            s = np.concatenate([np.empty(0)] + [
                np.einsum("ij,ij->i", query[at[q[i:i + 65536]]], other[o[i:i + 65536]])
                for i in range(0, len(q), 65536)])
            q, o, s, p = _placed(q, o, np.round(s, TIE_DIGITS), other_w, k)
            out.append((at[q], o, s, p))

        left = np.ones(len(query_w), bool)
        if len(rows) >= CELLS_FROM:
            unit = knn_cells.is_unit(query)
            cells = knn_cells.dealt(o32, knn_cells.is_unit(other), margin)
            todo = np.flatnonzero(unit) if cells else []
            start, size, worth = 0, knn_cells.TRIED, knn_cells.WORTH
            while start < len(todo):
                at = todo[start:start + size]
                found = knn_cells.candidates(q32[at], cells, low[at], high[at], k, margin, worth)
                if found is None and worth is not None:
                    break
                if found is not None:
                    settled(at, *found)
                    left[at] = False
                start, size, worth = start + size, -(-knn_cells.BATCH // k), None
        some = np.flatnonzero(left)
        for start in range(0, len(some), QUERY_ROWS):
            at = some[start:start + QUERY_ROWS]
            found = _candidates(q32[at], o32, low[at], high[at], k, margin)
            if found is None:
                q, o, s, p = _dense(query[at], query_w[at], other, other_w, k, excl, metric)
                out.append((at[q], o, s, p))
            else:
                settled(at, *found)
    else:
        out.append(_dense(query, query_w, other, other_w, k, excl, metric))
    q, o, s, p = (np.concatenate(x) for x in zip(*out))
    if (np.diff(q) < 0).any():      # some queries were settled by cells, others not
        order = np.argsort(q, kind="stable")
        q, o, s, p = q[order], o[order], s[order], p[order]
    return q, rows[o], s, p


def _placed(r, c, s, other_w, k):
    """The k best of each row, in order."""
    order = np.lexsort((other_w[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)  # from where the run of this query row starts
    keep = place < k
    return r[keep], c[keep], s[keep], place[keep]


def _true_at(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true entries, looked for eight at a time."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64) != 0)
    e, o = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[e] * 8 + o


def _candidates(q32, o32, low, high, k, margin):
    """(row, column) of all pairs that may be among the k best of a row; None if they are too many.

    Columns ``low`` to ``high`` of a row are barred. The k-th best so far is raised as columns go by.
    Scores are looked at by the best of ``GROUP_COLS`` columns, and one by one where that is a hit.
    """
    rows, cols = len(q32), len(o32)
    limit = np.full(rows, -np.inf, np.float32)
    bar = np.full(rows, LEAST, np.float32)
    turned = np.ascontiguousarray(q32.T)
    room = np.empty((max(STEP_COLS, FIRST_COLS, 8 * k), rows), np.float32)
    held, n_held, at, renew = [], 0, 0, 0
    while at < cols:
        width = min(STEP_COLS, 3 * at) if at else max(FIRST_COLS, 8 * k)
        end = min(cols, at + width)
        score = np.matmul(o32[at:end], turned, out=room[:end - at])
        for r in np.flatnonzero((high > low) & (low < end) & (high > at)):
            score[max(low[r], at) - at:min(high[r], end) - at, r] = -np.inf
        if not at:
            limit = np.partition(np.ascontiguousarray(score.T), end - k, axis=1)[:, end - k].copy()
            bar = np.maximum(limit - np.float32(margin), LEAST)
        whole = (end - at) // GROUP_COLS * GROUP_COLS
        grouped = score[:whole].reshape(-1, GROUP_COLS, rows)
        g, r = np.divmod(_true_at(grouped.max(axis=1) >= bar), rows)
        v = grouped[g, :, r]
        h, c = np.nonzero(v >= bar[r][:, None])
        held.append((r[h], g[h] * GROUP_COLS + c + at, v[h, c]))
        c, r = np.nonzero(score[whole:] >= bar)
        held.append((r, c + whole + at, score[whole:][c, r]))
        n_held += len(h) + len(c)
        if n_held > MOST_CANDIDATES * k * rows:
            return None
        at = end
        if at >= renew or at == cols:
            held = [knn_cells.trimmed(held, limit, k, margin)]
            bar = np.maximum(limit - np.float32(margin), LEAST)
            n_held, renew = len(held[0][0]), 2 * at
    return held[0][:2]


def _dense(query, query_w, other, other_w, k, excl, metric):
    """As ``_best``, all products in double precision."""
    out = [(np.empty(0, np.int64),) * 2 + (np.empty(0), np.empty(0, np.int64))]
    n_other = len(other_w)
    step = max(1, min(QUERY_ROWS, DENSE // max(1, n_other)))
    if metric == "euclidean":
        other_sq = np.einsum("ij,ij->i", other, other)
    for start in range(0, len(query_w), step):
        q, qw = query[start:start + step], query_w[start:start + step]
        score = q @ other.T
        if metric == "euclidean":
            q_sq = np.einsum("ij,ij->i", q, q)
            score = 2.0 * score - q_sq[:, None] - other_sq[None, :]
        if excl:
            barred = np.abs(qw[:, None] - other_w[None, :]) <= excl
        else:
            barred = qw[:, None] == other_w[None, :]
        score[barred] = -np.inf
        if n_other > k:
            limit = np.partition(score, n_other - k, axis=1)[:, n_other - k]
        else:
            limit = np.full(len(qw), -np.inf)
        # the slack keeps everything that may still tie once rounded
        r, c = np.nonzero((score >= limit[:, None] - SLACK) & np.isfinite(score))
        if metric == "euclidean":
            diff = q[r] - other[c]
            s = np.round(-np.sqrt(np.einsum("ij,ij->i", diff, diff)), TIE_DIGITS)
        else:
            s = np.round(score[r, c], TIE_DIGITS)
        r, c, s, place = _placed(r, c, s, other_w, k)
        out.append((r + start, c, s, place))
    return tuple(np.concatenate(x) for x in zip(*out))


def with_block_pairs(emb: DataFrame, keys: list[str], n_blocks) -> DataFrame:
    """Each row once per pair of blocks its own block takes part in."""
    b = F.col("block")
    other = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda c: F.struct(F.least(b, c).alias("lo"), F.greatest(b, c).alias("hi")))
    return (emb.withColumn("block", F.pmod(F.xxhash64("w"), n_blocks).cast("int"))
            .withColumn("pair", F.explode(other))
            .select(*keys, "w", "vec", "block", "pair.lo", "pair.hi"))


def n_blocks(block_rows: int | None, n_windows: int) -> int:
    rows = block_rows or max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], n_windows // BLOCKS_WANTED))
    return -(-n_windows // rows)


def partitions(emb: DataFrame, block_rows: int | None, n_windows: int) -> int:
    """Several for each pair of blocks, so that few pairs share one; the number is kept, since
    pairs take far more time than their bytes suggest."""
    n = n_blocks(block_rows, n_windows)
    least = int(emb.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(4096, SPREAD * n * (n + 1) // 2))


def blocked(emb: DataFrame, keys: list[str], block_rows: int | None,
            n_windows: int | None) -> tuple[DataFrame, bool]:
    """Rows with their block pairs, and whether a single block holds every space.

    Where the number of windows is known, neither a count nor a join is needed.
    """
    if n_windows is not None:
        n = n_blocks(block_rows, n_windows)
        if n <= 1:
            zero = F.lit(0)
            return emb.select("*", zero.alias("block"), zero.alias("lo"), zero.alias("hi")), True
        return with_block_pairs(emb, keys, F.lit(n)), False
    count = F.count(F.lit(1))
    rows = F.lit(block_rows) if block_rows else F.greatest(
        F.lit(BLOCK_ROWS[0]), F.least(F.lit(BLOCK_ROWS[1]), count / F.lit(BLOCKS_WANTED)))
    sizes = emb.groupBy(*keys).agg(F.ceil(count / rows).cast("int").alias("n_blocks"))
    return with_block_pairs(attach(emb, sizes, keys), keys, F.col("n_blocks")), False


def knn_edges(emb: DataFrame, keys: list[str], k: int = 5, excl: int = 0,
              metric: str = "cosine", block_rows: int | None = None,
              n_windows: int | None = None) -> DataFrame:
    """Directed edges (keys, i, j, rank, sim) to the k nearest other windows.

    ``emb`` has the key columns, ``w`` (bigint) and ``vec``. ``excl`` bars neighbours
    within that many windows. ``sim`` is the cosine, or the negative distance for
    ``metric="euclidean"``. Ties go to the smaller window index. ``n_windows``, if known,
    is the largest number of windows of any space; like ``block_rows``, to be lowered for very
    wide vectors, it only decides how spaces are cut.
    """
    names = list(keys)
    schema = T.StructType(
        [emb.schema[c] for c in names]
        + [T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
           T.StructField("sim", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    packed = T.StructType(
        [emb.schema[c] for c in names]
        + [T.StructField("range", T.LongType()), T.StructField("i", T.ArrayType(T.LongType())),
           T.StructField("j", T.ArrayType(T.LongType())),
           T.StructField("sim", T.ArrayType(T.DoubleType()))])

    def found(key, table):
        block = table.column("block").to_numpy()
        w = table.column("w").to_numpy()
        vec = _matrix(table.column("vec"))
        if metric == "cosine":
            vec = vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-12)
        lo, hi = key[-2].as_py(), key[-1].as_py()
        parts = [(np.empty(0, np.int64),) * 2 + (np.empty(0), np.empty(0, np.int64))]
        for mine, theirs in [(lo, hi)] if lo == hi else [(lo, hi), (hi, lo)]:
            m, t = block == mine, block == theirs
            if m.any() and t.any():
                q, o, s, p = _best(vec[m], w[m], vec[t], w[t], k, excl, metric)
                parts.append((w[m][q], w[t][o], s, p + 1))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def edges(key, i, j, s, p):
        cols = [pa.repeat(key[n], len(i)) for n in range(len(names))]
        return pa.table(cols + [pa.array(i), pa.array(j), pa.array(s),
                                pa.array(p.astype(np.int32))],
                        names=names + ["i", "j", "sim", "rank"])

    def compare(key, table):
        return edges(key, *found(key, table))

    def pack(key, table):
        i, j, s, _ = found(key, table)
        span = i // MERGE_WINDOWS
        order = np.argsort(span, kind="stable")
        span = span[order]
        first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]]) if len(span) else np.empty(0, int)
        cuts = pa.array(np.r_[first, len(span)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (i, j, s)]
        return pa.table([pa.repeat(key[n], len(first)) for n in range(len(names))]
                        + [pa.array(span[first]), *lists], names=packed.names)

    def merge(key, table):
        i, j, s = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("i", "j", "sim"))
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        return edges(key, i[keep], j[keep], s[keep], place[keep] + 1)

    pairs, single = blocked(emb.select(*names, F.col("w").cast("bigint"), "vec"), names,
                            block_rows, n_windows)
    if single:
        return pairs.groupBy(*names, "lo", "hi").applyInArrow(compare, schema)
    if n_windows is None:     # spaces may be many and small
        by_window = Window.partitionBy(*names, "i").orderBy(F.col("sim").desc(), "j")
        return (pairs.groupBy(*names, "lo", "hi").applyInArrow(compare, schema)
                .withColumn("rank", F.row_number().over(by_window)).filter(F.col("rank") <= k))
    pairs = pairs.repartition(partitions(emb, block_rows, n_windows), *names, "lo", "hi")
    return (pairs.groupBy(*names, "lo", "hi").applyInArrow(pack, packed)
            .groupBy(*names, "range").applyInArrow(merge, schema))
