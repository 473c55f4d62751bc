"""Candidates for the nearest neighbours among the rows of a block, cell by cell.

Rows of length one are dealt into cells around pivots. A row of a cell is at least as far from a
query as the pivot is, less the cell's radius, both as angles: a cell whose nearest possible row is
farther than the query's k-th best so far is not compared. Each query decides for itself, after its
nearest cells gave it a first bound. With few dimensions that leaves a small part of all pairs; with
many it leaves nearly all, and the caller then compares them without cells.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Rows of a cell, rounds in which pivots move to the middle of their rows.
CELL_ROWS, ROUNDS = 200, 2
#: Cells of a query that give its first bound, and rows of the first from which that is read.
NEAREST, FIRST_ROWS = 3, 64
#: Places of the queries of one batch, queries tried first, and queries and rows of one product.
BATCH, TRIED, STEP, STEP_ROWS = 1 << 17, 1024, 2048, 1024
#: Share of pairs left above which cells are not worth their trouble.
WORTH = 0.5
#: Candidates held of each of the k places.
MOST_CANDIDATES = 32
LEAST = np.finfo(np.float32).min
#: How far lengths may be from one, and what that and rounded pivots may add to a product.
UNIT, TURN = 1e-9, 1e-6


class Cells(NamedTuple):
    rows: np.ndarray      # in single precision, by cell
    order: np.ndarray     # where each of them was
    starts: np.ndarray    # first row of each cell, and the end
    pivots: np.ndarray
    radius: np.ndarray    # as an angle; rows that are not of length one have no pivot


def is_unit(x: np.ndarray) -> np.ndarray:
    return np.abs(np.sqrt(np.einsum("ij,ij->i", x, x)) - 1) < UNIT


def _nearest(x32: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, sim = np.empty(len(x32), np.int64), np.empty(len(x32), np.float32)
    for i in range(0, len(x32), 4096):
        product = x32[i:i + 4096] @ pivots.T
        own[i:i + 4096] = at = product.argmax(axis=1)
        sim[i:i + 4096] = product[np.arange(len(at)), at]
    return own, sim


def dealt(x32: np.ndarray, unit: np.ndarray, margin: float) -> Cells | None:
    """Rows by cell; the last one has the rows that are not of length one, whatever their number."""
    at, odd = np.flatnonzero(unit), np.flatnonzero(~unit)
    if len(at) < 2 * CELL_ROWS:
        return None
    x = x32[at]
    pivots = x[np.linspace(0, len(at) - 1, len(at) // CELL_ROWS).astype(np.int64)]
    own, sim = _nearest(x, pivots)
    for _ in range(ROUNDS):
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        middle = np.add.reduceat(x[order], first, axis=0, dtype=np.float64)
        length = np.linalg.norm(middle, axis=1, keepdims=True)
        pivots = np.where(length > 1e-3, middle / np.maximum(length, 1e-3),
                          pivots[own[order[first]]]).astype(np.float32)
        own, sim = _nearest(x, pivots)
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
    least = np.minimum.reduceat(sim[order], first).astype(np.float64) - margin - TURN
    rows = np.r_[at[order], odd]
    return Cells(x32[rows], rows, np.r_[first, len(at), len(rows)], pivots[own[order[first]]],
                 np.arccos(np.clip(least, -1, 1)))


def trimmed(held: list, limit: np.ndarray, k: int, margin: float) -> tuple:
    """Held (row, column, score) that may be among the k best; raises the limits of their rows."""
    r, c, v = (np.concatenate(x) for x in zip(*held))
    # by row and falling score: the bits of a single-precision number, in rising order
    bits = v.view(np.int32).astype(np.int64)
    order = np.argsort((r << 33) - np.where(bits < 0, -(bits & 0x7FFFFFFF), bits))
    r, c, v = r[order], c[order], v[order]
    kth = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
    limit[r[kth]] = np.maximum(limit[r[kth]], v[kth])
    keep = (v >= limit[r] - np.float32(margin)) & np.isfinite(v)
    return r[keep], c[keep], v[keep]


def candidates(q32: np.ndarray, cells: Cells, low: np.ndarray, high: np.ndarray, k: int,
               margin: float, worth: float | None = None):
    """(row, column) of all pairs that may be among the k best of a row; None if they are too many,
    or if more than ``worth`` of all pairs are left. Queries are of length one.

    Columns ``low`` to ``high`` of a row, as they were before they were dealt, are barred.
    """
    n, n_cells = len(q32), len(cells.radius)
    n_barred = int((high - low).max(initial=0))
    limit = np.full(n, -np.inf, np.float32)
    bar = np.full(n, LEAST, np.float32)
    none = np.empty(0, np.int64)
    held, n_held = [(none, none, np.empty(0, np.float32))], 0

    def compare(cell, queries, first=False):
        nonlocal n_held
        begins = range(cells.starts[cell], cells.starts[cell + 1], STEP_ROWS)
        for at, begin in ((at, b) for at in range(0, len(queries), STEP) for b in begins):
            if n_held > MOST_CANDIDATES * k * n:
                return
            q, end = queries[at:at + STEP], min(begin + STEP_ROWS, cells.starts[cell + 1])
            score = cells.rows[begin:end] @ q32[q].T
            if first and begin == begins[0] and end - begin >= k + n_barred:
                some = np.ascontiguousarray(score[:max(FIRST_ROWS, 8 * (k + n_barred))].T)
                place = some.shape[1] - k - n_barred
                limit[q] = np.partition(some, place, axis=1)[:, place]
                bar[q] = np.maximum(limit[q] - np.float32(margin), LEAST)
            hit = np.flatnonzero(score.max(axis=0) >= bar[q])
            if not len(hit):
                continue
            q, score = q[hit], score[:, hit]
            c, r = np.nonzero(score >= bar[q])
            v, r, c = score[c, r], q[r], c + begin
            if n_barred:
                was = cells.order[c]
                free = (was < low[r]) | (was >= high[r])
                r, c, v = r[free], c[free], v[free]
            held.append((r, c, v))
            n_held += len(r)

    def renew():
        nonlocal n_held
        held[:] = [trimmed(held, limit, k, margin)]
        n_held = len(held[0][0])
        np.maximum(limit - np.float32(margin), LEAST, out=bar)
        angle = np.arccos(np.clip(limit.astype(np.float64) - margin - TURN, -1, 1))
        return angle, np.cos(angle).astype(np.float32), np.sin(angle).astype(np.float32)

    def left(cell):
        """Queries whose k-th best may be improved by a row of the cell."""
        radius = cells.radius[cell]
        least = np.float32(np.cos(radius)) * cos - np.float32(np.sin(radius)) * sin
        open_ = near[cell] >= least - np.float32(margin + TURN)
        if radius + widest >= np.pi:
            open_ |= angle + radius >= np.pi
        return np.flatnonzero(open_ & (near[cell] > -2))

    near = q32 @ cells.pivots.T
    for turn in range(min(NEAREST, n_cells)):
        own = near.argmax(axis=1)
        near[np.arange(n), own] = -3
        by = np.argsort(own, kind="stable")
        for queries in np.split(by, np.flatnonzero(np.diff(own[by])) + 1):
            compare(own[queries[0]], queries, first=not turn)
        if n_held > MOST_CANDIDATES * k * n:
            return None
        angle, cos, sin = renew()
    near, widest = np.ascontiguousarray(near.T), angle.max()
    sizes = np.diff(cells.starts)
    if worth is not None and sum(int(sizes[c]) * len(left(c)) for c in range(n_cells)
                                 ) > worth * n * sizes.sum():
        return None
    if sizes[-1]:
        compare(n_cells, np.arange(n))
    kept = n_held
    for cell in range(n_cells):
        compare(cell, left(cell))
        if n_held > MOST_CANDIDATES * k * n:
            return None
        if n_held > 2 * max(kept, k * n) or cell == n_cells - 1:
            angle, cos, sin = renew()
            kept, widest = n_held, angle.max()
    r, c, _ = held[0]
    return r, cells.order[c]
