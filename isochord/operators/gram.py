"""Linear CKA of spaces wider than they are long, from window-by-window products.

With D features and W windows the cross-covariance form needs D x D sums, this one W x W: the
better one where D > W. Windows are cut into stripes and stripes dealt to blocks. A task holds one
pair of blocks, of both spaces, and multiplies them a pair of stripes at a time, so that neither a
D x D nor a W x W array exists anywhere. It returns three sums of products and the row sums of its
tile, all that centring needs:

    <K, L> centred = sum K L - 2/n sum_w k_w l_w + k l / n^2,   k_w, l_w row sums, k, l totals.

A rotation moves L along its diagonal and changes none of its products. Rotations near each other
therefore share a tile: stripes of the second space are longer by their reach, both products are
made once, and each rotation reads its own part of L. Windows that are missing are zero vectors
there; where most are, or a vector is not finite, each rotation has products of its own.

Stripes travel to tiles as bytes, and so do row sums to where those of their stripe meet; then
they are added by key, in an ordinary aggregate. Blocks shrink as vectors get wider, so a task's
memory is bounded by ``HELD`` numbers whatever D is, and larger as recordings get longer, so that
rows are copied to a fixed number of tiles until ``HELD`` is met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.functions.vectors import modulo
from isochord.operators.knn import BLOCKS_WANTED, SPREAD, _matrix
from isochord.operators.ordered import attach

#: Numbers of one side of one block, and of one strip of products.
HELD, STRIP = 1 << 21, 1 << 16
#: Windows of a stripe; rotations that share a tile differ by less than REACH.
STRIPE, REACH = 512, 128
CUT, PRODUCTS = ["stripe", "blocks", "bucket"], ["kk", "ll", "kl"]


def sharing(shifts: list[int], n: int, stripe: int, bucket: int) -> list[tuple[int, int]]:
    """(shift, rotation) of the shifts that share the tiles of a bucket."""
    return [(s, s % n) for s in shifts if s % n // max(1, min(REACH, stripe // 4)) == bucket]


def cuts(both: DataFrame, keys: list[str], block_windows: int | None, n: int | None,
         shifts: list[int]) -> DataFrame:
    """(keys, n, stripe, blocks, bucket, first, spread): how the windows of each key are cut, and
    the rotations that share its tiles."""
    count = F.greatest(F.count("vec_a"), F.count("vec_b"))
    widest = F.greatest(F.max(F.size("vec_a")), F.max(F.size("vec_b")), F.lit(1))
    rows = F.lit(block_windows) if block_windows else F.greatest(
        F.lit(16), F.least(F.greatest(F.lit(2048), F.ceil(count / BLOCKS_WANTED)),
                           F.floor(F.lit(HELD) / widest)))
    last = F.lit(n) if n else F.greatest(F.max("w") + 1, F.lit(1))
    stripes = F.ceil(F.col("n") / F.least(F.lit(STRIPE), "rows"))
    reach = F.greatest(F.lit(1), F.least(F.lit(REACH), F.floor(F.col("stripe") / 4)))
    rotations = F.explode(F.array(*[F.lit(s % (n or 1)).cast("bigint") for s in shifts]))
    return (both.groupBy(*keys).agg(last.cast("bigint").alias("n"), rows.cast("bigint").alias("rows"),
                                    count.alias("count"))
            .withColumn("stripe", F.ceil(F.col("n") / stripes))
            .withColumn("blocks", F.least(F.ceil(F.col("count") / F.col("rows")), stripes))
            .withColumn("rotation", rotations)
            .groupBy(*keys, "n", "stripe", "blocks", F.floor(F.col("rotation") / reach).alias("bucket"))
            .agg(F.min("rotation").alias("first"),
                 (F.max("rotation") - F.min("rotation")).alias("spread")))


def placed(both: DataFrame, keys: list[str], cut: DataFrame) -> DataFrame:
    """Rows of either space at their places ``at`` of stripes ``z``. A row of the second space is at
    v to v + spread in the rotations of a tile."""
    cut, rows = F.broadcast(cut), {}
    # once more before 0 if that passes the end
    start = F.pmod(F.col("w") + F.col("first"), F.col("n"))
    turns = F.explode(F.when(start + F.col("spread") < F.col("n"), F.array(start))
                      .otherwise(F.array(start, start - F.col("n"))))
    reached = F.explode(F.sequence(
        F.floor(F.greatest(F.col("v"), F.lit(0)) / F.col("stripe")),
        F.floor(F.least(F.col("v") + F.col("spread"), F.col("n") - 1) / F.col("stripe"))))
    rows["a"] = (attach(both.filter("vec_a IS NOT NULL"), cut, keys)
                 .withColumn("vec_b", F.lit(None).cast(both.schema["vec_b"].dataType))
                 .withColumn("z", F.floor(F.col("w") / F.col("stripe")))
                 .withColumn("at", F.col("w") - F.col("z") * F.col("stripe")))
    rows["b"] = (attach(both.filter("vec_b IS NOT NULL"), cut, keys)
                 .withColumn("vec_a", F.lit(None).cast(both.schema["vec_a"].dataType))
                 .withColumn("v", turns).withColumn("z", reached)
                 .withColumn("at", F.col("v") - F.col("z") * F.col("stripe") + F.col("spread")))
    columns = [*keys, *CUT, "z", F.col("at").cast("int").alias("at"), "vec_a", "vec_b"]
    return rows["a"].select(*columns).unionAll(rows["b"].select(*columns))


def kept_type(vectors: T.ArrayType) -> str:
    return "<f4" if isinstance(vectors.elementType, T.FloatType) else "<f8"


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each stripe: places and vectors of both spaces as bytes, since stripes travel to
    as many tiles as there are blocks."""
    by = [*keys, *CUT, "z"]
    parts = ["at_a", "vec_a", "at_b", "vec_b"]
    schema = T.StructType([*(rows.schema[c] for c in by),
                           *(T.StructField(c, T.BinaryType()) for c in parts)])
    types = {c: kept_type(rows.schema[c].dataType) for c in ("vec_a", "vec_b")}

    def pack(key: tuple, stripe: pa.Table) -> pa.Table:
        held = []
        for c, kind in types.items():
            mine = stripe.filter(stripe.column(c).is_valid())
            held += [mine.column("at").to_numpy().astype("<i4").tobytes(),
                     _matrix(mine.column(c)).astype(kind).tobytes()]
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key),
                         *(pa.array([h], pa.binary()) for h in held)], schema.names)

    return rows.groupBy(*by).applyInArrow(pack, schema)


def unpacked(tile: pa.Table, side: str, kind: str, chosen: np.ndarray):
    """(z, at, vectors) of one space from some of the stripes of a tile."""
    z, at, vec = ([], [], [])
    for row in np.flatnonzero(chosen):
        place = np.frombuffer(tile.column(f"at_{side}")[row].as_py(), "<i4")
        if len(place):
            found = np.frombuffer(tile.column(f"vec_{side}")[row].as_py(), kind)
            z.append(np.full(len(place), tile.column("z")[row].as_py()))
            at.append(place)
            vec.append(found.reshape(len(place), -1))
    if not z:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0))
    return np.concatenate(z), np.concatenate(at).astype(np.int64), np.concatenate(vec).astype(np.float64)


def in_tiles(stripes: DataFrame) -> DataFrame:
    """Stripes in all tiles of their block."""
    block = F.pmod("z", "blocks").alias("block")
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("partner")
    return (stripes.select("*", block, partner)
            .withColumns({"x": F.least("block", "partner"), "y": F.greatest("block", "partner")})
            .drop("block", "partner"))


class Grid:
    """Vectors of a side in whole stripes: absent windows are zero, copies are added up."""

    def __init__(self, z: np.ndarray, at: np.ndarray, vec: np.ndarray, stripes: np.ndarray,
                 size: int):
        here = np.isin(z, stripes)
        self.cell = np.searchsorted(stripes, z[here]) * size + at[here]
        self.rows = vec[here]
        self.count = np.bincount(self.cell, minlength=len(stripes) * size).astype(np.float64)
        self.twice = bool(len(self.count)) and self.count.max() > 1
        self.vec = np.zeros((len(self.count), vec.shape[1]))
        if self.twice:
            np.add.at(self.vec, self.cell, self.rows)
        else:
            self.vec[self.cell] = self.rows
        self.vec = self.vec.reshape(len(stripes), size, vec.shape[1])
        self.count = self.count.reshape(len(stripes), size)


class Half:
    """One block of a tile: grids of both spaces and, for each rotation, how often each of the
    windows of one space is met by the other."""

    def __init__(self, stripes, a_rows, b_rows, stripe, starts, spread):
        self.stripes = stripes
        self.a, self.b = (Grid(*a_rows, stripes, stripe), Grid(*b_rows, stripes, stripe + spread))
        self.met_a = np.stack([self.b.count[:, s:s + stripe] for s in starts], 2)
        self.met_b = np.zeros((len(stripes), stripe + spread, len(starts)))
        for c, s in enumerate(starts):
            self.met_b[:, s:s + stripe, c] = self.a.count
        self.plain = ((self.met_a == 1) | (self.a.count[..., None] == 0)).all(axis=(1, 2))


def square_sums(x: np.ndarray, x_met: np.ndarray, y: np.ndarray, y_met: np.ndarray) -> np.ndarray:
    """Sums of squared products of all rows, each row as often as it is met."""
    sums = np.zeros(x_met.shape[1])
    step = max(1, STRIP // STRIPE)
    for i in range(0, len(x), step):
        for j in range(0, len(y), STRIPE):
            k = x[i:i + step] @ y[j:j + STRIPE].T
            sums += (np.square(k, out=k) @ y_met[j:j + STRIPE] * x_met[i:i + step]).sum(0)
    return sums


def products(one: Half, two: Half, stripe: int, starts: list[int], spread: int) -> np.ndarray:
    """Sums of K K, L L and K L over a tile, for each rotation (columns)."""
    pitch, step = stripe + spread, max(1, min(stripe, STRIP // stripe))
    sums = np.zeros((3, len(starts)))
    # rows of K end in zeros, so that a rotation of L is one run of numbers as long as K
    k_all, squares = np.zeros((step, pitch)), np.empty((step + spread, pitch))
    l_run = np.zeros(pitch * pitch + spread)
    l_all = l_run[:pitch * pitch].reshape(pitch, pitch)
    a_once, b_once = (not (getattr(one, s).twice or getattr(two, s).twice) for s in "ab")
    for i in range(len(one.stripes)):
        for j in range(i if one is two else 0, len(two.stripes)):
            sides = 1 if one is two and i == j else 2   # the tile on the other side is this one turned
            plain, done, found = one.plain[i] and two.plain[j], 0, np.zeros((3, len(starts)))
            for top in range(0, stripe, step):
                end = min(top + step, stripe)
                new = l_all[done:end + spread]
                np.matmul(one.b.vec[i, done:end + spread], two.b.vec[j].T, out=new)
                if b_once:
                    square = np.square(new, out=squares[:len(new)])
                    found[1] += (square @ two.met_b[j] * one.met_b[i, done:end + spread]).sum(0)
                done = end + spread
                k = k_all[:end - top]
                np.matmul(one.a.vec[i, top:end], two.a.vec[j].T, out=k[:, :stripe])
                run = k.reshape(-1)
                if a_once and plain:
                    found[0] += run @ run
                elif a_once:
                    square = np.square(k[:, :stripe])
                    found[0] += (square @ two.met_a[j] * one.met_a[i, top:end]).sum(0)
                for c, s in enumerate(starts):
                    at = (top + s) * pitch + s
                    found[2, c] += run @ l_run[at:at + len(run)]
            sums += sides * found
    for place, side, once in ((0, "a", a_once), (1, "b", b_once)):
        if not once:        # copies of a window have products of their own
            (x, x_met), (y, y_met) = (
                (g.rows, met.reshape(-1, len(starts))[g.cell]) for g, met in (
                    (getattr(h, side), getattr(h, f"met_{side}")) for h in (one, two)))
            sums[place] = square_sums(x, x_met, y, y_met) * (1 if one is two else 2)
    return sums


def row_sums(half: Half, other: Half, c: int, start: int, stripe: int):
    """(place, k, l) of the windows of a half that both spaces have at a rotation."""
    part = slice(start, start + stripe)
    k = half.a.vec @ np.einsum("zw,zwf->f", other.met_a[..., c], other.a.vec)
    l = half.b.vec[:, part] @ np.einsum("zw,zwf->f", other.a.count, other.b.vec[:, part])
    z, at = np.nonzero((half.a.count > 0) & (half.met_a[..., c] > 0))
    return ((half.stripes[z], at), (k * half.met_a[..., c])[z, at], (l * half.a.count)[z, at])


def aligned(a_rows, b_rows, stripe: int, start: int):
    """Rows of the windows that both sides have at one rotation, in stripes of their own; the
    windows of the new places."""
    (za, at_a, a), (zb, at_b, b) = a_rows, b_rows
    inside = (at_b >= start) & (at_b < start + stripe)
    wa, wb = za * stripe + at_a, (zb * stripe + at_b - start)[inside]
    w = np.intersect1d(wa, wb)
    in_a, in_b = np.isin(wa, w), np.isin(wb, w)
    to_a, to_b = np.searchsorted(w, wa[in_a]), np.searchsorted(w, wb[in_b])
    return ((to_a // stripe, to_a % stripe, a[in_a]),
            (to_b // stripe, to_b % stripe, b[inside][in_b]), w)


def tile_sums(both: DataFrame, keys: list[str], block_windows: int | None = None,
              n_tasks: int | None = None, n_windows: int | None = None,
              shifts: list[int] | tuple[int, ...] = (0,)) -> DataFrame:
    """(keys, shift, z, k, l, kk, ll, kl, at, k_rows, l_rows): of each stripe in a tile the row sums as
    bytes, with their places, and their totals; on one row of each tile and rotation, sums of products.

    ``both`` has the keys, ``w``, ``vec_a`` and ``vec_b``, of which one may be missing; vectors of
    one key have one length each. Rotations need the number of windows.
    """
    names, n = list(keys), n_windows or 1
    both = both.withColumn("w", F.col("w").cast("bigint"))
    cut = cuts(both, names, block_windows, n_windows, shifts)
    tiles = in_tiles(packed(placed(both, names, cut), names))
    whole = T.IntegerType() if all(abs(s) < 1 << 31 for s in shifts) else T.LongType()
    schema = T.StructType([*(both.schema[c] for c in names), T.StructField("shift", whole),
                           T.StructField("z", T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("k", "l", *PRODUCTS)),
                           *(T.StructField(c, T.BinaryType()) for c in ("at", "k_rows", "l_rows"))])
    types = {s: kept_type(both.schema[f"vec_{s}"].dataType) for s in "ab"}

    def sums_of(key: tuple, tile: pa.Table):
        """(shift, windows, k, l, the three sums) of each rotation and block."""
        stripe, blocks, bucket, x, y = (c.as_py() for c in key[len(names):])
        some, places = sharing(shifts, n, stripe, bucket), [x] if x == y else [x, y]
        first, last = min(r for _, r in some), max(r for _, r in some)
        block = tile.column("z").to_numpy() % blocks
        sides = [[unpacked(tile, s, kind, block == p) for p in places] for s, kind in types.items()]
        stripes = [np.intersect1d(a[0], b[0]) for a, b in zip(*sides)]
        full = sum(len(a[0]) for a in sides[0]) * 2 >= sum(map(len, stripes)) * stripe
        if full and all(np.isfinite(r[2]).all() for rows in sides for r in rows):
            starts = [last - r for _, r in some]
            sets = [([Half(s, a, b, stripe, starts, last - first) for s, a, b in zip(stripes, *sides)],
                     some, starts, last - first, None)]
        else:
            sets = []
            for one in some:
                parts = [aligned(a, b, stripe, last - one[1]) for a, b in zip(*sides)]
                halves = [Half(np.arange(-(-len(w) // stripe)), a, b, stripe, [0], 0)
                          for a, b, w in parts]
                sets.append((halves, [one], [0], 0, [w for *_, w in parts]))
        for halves, some, starts, spread, windows in sets:
            if not all(len(h.stripes) for h in halves):
                continue
            sums = products(halves[0], halves[-1], stripe, starts, spread)
            for c, (shift, _) in enumerate(some):
                rest = sums[:, c]
                for p, half in enumerate(halves):
                    (z, at), k, l = row_sums(half, halves[-1 - p], c, starts[c], stripe)
                    w = z * stripe + at
                    yield shift, w if windows is None else windows[p][w], k, l, rest
                    rest = np.zeros(3) if len(w) else rest

    def summed(key: tuple, tile: pa.Table) -> pa.Table:
        rows, stripe = [], key[len(names)].as_py()
        for shift, w, k, l, rest in sums_of(key, tile):
            z, begin = np.unique(w // stripe, return_index=True)
            for one, part in zip(z, np.split(np.arange(len(w)), begin[1:])):
                rows.append((shift, one, k[part].sum(), l[part].sum(), *rest,
                             (w[part] % stripe).astype("<i4").tobytes(), k[part].tobytes(), l[part].tobytes()))
                rest = np.zeros(3)
        columns = [*zip(*rows)] or [()] * (len(schema) - len(names))
        types = [pa.int32() if whole == T.IntegerType() else pa.int64(), pa.int64(), *[pa.float64()] * 5,
                 *[pa.binary()] * 3]
        return pa.table([*(pa.repeat(key[c], len(rows)) for c in range(len(names))),
                         *(pa.array(c, t) for c, t in zip(columns, types))], schema.names)

    by = [*names, *CUT, "x", "y"]
    if n_tasks:
        tiles = tiles.repartition(n_tasks, *by)
    return tiles.groupBy(*by).applyInArrow(summed, schema)


def by_stripe(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, k, l, k_k, l_l, k_l, kk, ll, kl): windows of a stripe, sums over them of their row sums
    and of products of these, and sums of products."""
    sums = ["n", "k", "l", "k_k", "l_l", "k_l", *PRODUCTS]
    schema = T.StructType([*(tiles.schema[c] for c in keys),
                           *(T.StructField(c, T.DoubleType()) for c in sums)])

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        at, k, l = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in parts.column(c)])
                    for c, kind in (("at", "<i4"), ("k_rows", "<f8"), ("l_rows", "<f8")))
        k, l = np.bincount(at, k), np.bincount(at, l)
        found = [len(np.unique(at)), k.sum(), l.sum(), k @ k, l @ l, k @ l,
                 *(parts.column(c).to_numpy().sum() for c in PRODUCTS)]
        return pa.table([*(pa.array([v.as_py()], v.type) for v in key[:-1]),
                         *(pa.array([v], pa.float64()) for v in found)], schema.names)

    return tiles.groupBy(*keys, "z").applyInArrow(meet, schema)


def gram_cka(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str], on: list[str],
             n_windows: int, shifts: list[int], block_windows: int | None = None) -> DataFrame:
    """(on, a_keys, b_keys, shift, cka), as ``cka_at_shifts`` has it, for wide spaces.

    Windows that only one side has, or whose vector is NULL, are left out, on both sides. A space that
    does not vary has a CKA of 0; an empty side gives no rows.
    """
    windows, spaces = max(1, n_windows), [*on, *a_keys, *b_keys]

    def side(emb, other, keys, name):
        """The rows once for each space of the other side."""
        met = other.groupBy(*on, *keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        vec = [F.col("vec").alias(c) if c == name else F.lit(None).cast(t).alias(c)
               for c, t in (("vec_a", a.schema["vec"].dataType), ("vec_b", b.schema["vec"].dataType))]
        return attach(emb, F.broadcast(met), on).select(
            *spaces, F.col("w").cast("bigint").alias("w"), *vec)

    both = (side(a, b, b_keys, "vec_a").filter((F.col("w") >= 0) & (F.col("w") < windows))
            .unionAll(side(b, a, a_keys, "vec_b").filter("w IS NOT NULL")
                      .withColumn("w", modulo(F.col("w"), windows))))
    keys = [*spaces, "shift"]
    blocks = -(-windows // (block_windows or max(2048, -(-windows // BLOCKS_WANTED))))
    n_tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                  min(4096, SPREAD * blocks * (blocks + 1) // 2))
    tiles = tile_sums(both, spaces, block_windows, n_tasks, windows, list(dict.fromkeys(shifts)))
    n = F.sum("n")

    def centred(products, pairs, x, y):
        return (F.sum(products) - 2 * F.sum(pairs) / n + F.sum(x) * F.sum(y) / (n * n))
    scale = F.sqrt(F.greatest(centred("kk", "k_k", "k", "k"), F.lit(0.0))
                   * F.greatest(centred("ll", "l_l", "l", "l"), F.lit(0.0)))
    return by_stripe(tiles, keys).groupBy(*keys).agg(
        F.when(scale == 0, 0.0).otherwise(centred("kl", "k_l", "k", "l") / (scale + F.lit(1e-20)))
        .alias("cka"))
