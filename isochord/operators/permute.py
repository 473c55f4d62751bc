"""Permutation nulls: draws as tables, graphs relabelled by join, enrichment tests.

Draws come from a fixed hash of (draw number, position), so that they are reproducible
on any engine, any number of executors and after any lost task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from isochord.operators import stats
from isochord.operators.knn import _matrix
from isochord.operators.ordered import attach, by_ratio, merged, quantiles
from isochord.operators.regrid import vector_sum
from isochord.session import written

PRIME = 2147483647
# statistics compared with their null are rounded, so that equal ones count as equal
TIE_DIGITS = 9
# a task sorts about this many windows of a draw, and makes as many places
PART = 16384
# windows of a cut, whose edges meet in one task; draws taken together; ranges of windows in which
# draws are dealt out, and cuts of such a range, at most; bits of the table that sieves edges.
# A place in a cut and one among draws taken together make up 16 bits
CUT_BITS, DRAWS_TOGETHER, RANGES, MOST_CUTS, SIEVE_BITS = 13, 8, 8, 32, 20
CUT = 1 << CUT_BITS


def draw_index(r: Column, m: Column, n: int, stream: int = 0) -> Column:
    """Pseudo-random index 0..n-1 of draw r, place m (arithmetic modulo a prime)."""
    p = F.lit(PRIME).cast("bigint")
    a = (r * 48271 + m * 69621 + stream * 15485863 + 1) % p
    b = (a * 16807) % p
    c = (b * b + a) % p
    d = (c * c + b) % p
    return d % n


def permutation_table(spark: SparkSession, n: int, n_draws: int, salt: str = "") -> DataFrame:
    """(draw, old, new): ``old`` sits at position ``new`` in that draw.

    Positions are ranks of hashes. Leading digits of a hash cut a draw into even parts, each
    sorted by itself; what lies in the parts before is counted.
    """
    digits = 1
    while n > PART * 16 ** digits:
        digits += 1
    h = F.md5(F.concat(F.lit(salt), F.col("draw").cast("string"), F.lit(":"),
                       F.col("old").cast("string")))
    rows = (spark.range(n * n_draws).select(F.floor(F.col("id") / n).alias("draw"),
                                            (F.col("id") % n).alias("old"))
            .withColumn("h", h).withColumn("part", F.substring("h", 1, digits)))
    parts = Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("draw", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("draw", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("draw", "part").orderBy("h", "old"))
    return (rows.withColumn("inside", inside).join(before, ["draw", "part"])
            .select("draw", "old", (F.col("before") + F.col("inside") - 1).cast("bigint")
                    .alias("new")))


def block_permutation_table(spark: SparkSession, n: int, block_len: int, n_draws: int,
                            salt: str = "b") -> DataFrame:
    """As above, but whole blocks of ``block_len`` windows change places.

    A block starts after the blocks placed before it; only the last may be shorter, which
    moves those placed behind it.
    """
    n_blocks = -(-n // block_len)
    last = n - (n_blocks - 1) * block_len
    order = permutation_table(spark, n_blocks, n_draws, salt).select(
        "draw", F.col("old").alias("block"), F.col("new").alias("place"))
    short = order.filter(F.col("block") == n_blocks - 1).select(
        "draw", F.col("place").alias("short"))
    size = F.when(F.col("block") == n_blocks - 1, last).otherwise(block_len)
    start = F.col("place") * block_len - F.when(F.col("place") > F.col("short"),
                                                block_len - last).otherwise(0)
    placed = order.join(short, "draw").select(
        "draw", "block", start.alias("start"),
        F.explode(F.sequence(F.lit(0), size - 1)).alias("o"))
    return placed.select(
        "draw", (F.col("block") * block_len + F.col("o")).cast("bigint").alias("old"),
        (F.col("start") + F.col("o")).cast("bigint").alias("new"))


def permuted_scores(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
                    on: list[str], perms: DataFrame, n_draws: int, n_windows: int, k: int,
                    pairs: DataFrame) -> DataFrame:
    """mKNN of a with b under every draw, per pair of spaces; draw -1 is the observed one.

    Edges of b meet their draws in pairs of ranges (of i and of j), a few draws at a time, and what
    they become travels packed to the range of its new i, where the edges of a wait. Copies of a
    draw number as the ranges, which widen with the recording; no edge is a row of its own in a draw.
    """
    spark = perms.sparkSession
    stay = spark.range(n_windows).select(F.lit(-1).cast("bigint").alias("draw"),
                                         F.col("id").alias("old"), F.col("id").alias("new"))
    moved = moved_edges(b, [*on, *b_keys], perms.select("draw", "old", "new").unionByName(stay),
                        n_draws, n_windows)
    given = (packed_edges(a, [*on, *a_keys], n_windows).select(
        *on, *a_keys, F.col("cut").alias("target"), "i", "j",
        _sets(n_draws)))
    schema = T.StructType([*(given.schema[c] for c in [*on, *a_keys]),
                           *(moved.schema[c] for c in b_keys),
                           T.StructField("draw", T.LongType()), T.StructField("hits", T.LongType())])

    def met(key: tuple, moved: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        theirs = [(x, (code & (CUT - 1)).astype(np.int64) * n_windows + j, code >> CUT_BITS)
                  for x, (j, packed) in _lists(moved, b_keys, ["j", "code"])
                  for code in [packed.view(np.uint16)]]
        for own, (i, j) in _lists(given, a_keys, ["i", "j"]):
            edges, times = np.unique(i.astype(np.int64) * n_windows + j, return_counts=True)
            known = np.zeros(1 << SIEVE_BITS, bool)
            known[_sieve(edges)] = True
            for other, edge, draw in theirs:
                may = np.flatnonzero(known[_sieve(edge)])
                edge, draw = edge[may], draw[may]
                at = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
                hits = np.bincount(draw, np.where(edges[at] == edge, times[at], 0), DRAWS_TOGETHER)
                out += [(*own, *other, d, int(hits[d])) for d in np.flatnonzero(hits)]
        first = key[-1].as_py() * DRAWS_TOGETHER - 1
        cols = list(zip(*out)) or [()] * (len(a_keys) + len(b_keys) + 2)
        cols[-2] = [int(d) + first for d in cols[-2]]
        cols = [[x.as_py()] * len(out) for x in key[:len(on)]] + cols
        return pa.table([pa.array(c, t) for c, t in zip(cols, to_arrow_schema(schema).types)],
                        schema.names)

    by = [*on, "target", "set"]
    found = moved.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(met, schema)
    keys = [*on, *a_keys, *b_keys, "draw"]
    hits = found.groupBy(*keys).agg(F.sum("hits").alias("hits"))
    every = F.sequence(F.lit(-1).cast("bigint"), F.lit(n_draws - 1).cast("bigint"))
    wanted = pairs.select(*on, *a_keys, *b_keys, F.explode(every).alias("draw"))
    return wanted.join(hits, keys, "left").select(
        *keys, (F.coalesce("hits", F.lit(0)) / F.lit(float(n_windows * k))).alias("score"))


def _sets(n_draws: int) -> Column:
    """Every set of draws, the observed one with the first."""
    return F.explode(F.sequence(F.lit(0), F.lit(n_draws // DRAWS_TOGETHER))).alias("set")


def _sieve(edge: np.ndarray) -> np.ndarray:
    """Places of edges in a table of marks, by a multiplied hash."""
    return (edge.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)


def _lists(table: pa.Table, keys: list[str], lists: list[str]):
    """Key and joined list columns of all rows with that key."""
    rows: dict[tuple, list[int]] = {}
    for n, key in enumerate(zip(*(table.column(c).to_pylist() for c in keys))):
        rows.setdefault(key, []).append(n)
    for key, at in rows.items():
        some = table.take(pa.array(at)) if len(rows) > 1 else table
        yield key, [some.column(c).combine_chunks().flatten().to_numpy() for c in lists]


def packed_edges(edges: DataFrame, keys: list[str], n_windows: int,
                 wide: int | None = None) -> DataFrame:
    """Edges by ``cut`` (a short range of i) as two lists, i counted from the start of the cut. With
    ``wide``, also by the ranges of that many windows that i and j lie in (``from``, ``to``), i and j
    counted from the start of these."""
    i, j = F.col("i"), F.col("j")
    inside = edges.filter(i.between(0, n_windows - 1) & j.between(0, n_windows - 1))
    number = "int" if n_windows < 1 << 31 else "bigint"
    ranges = [] if wide is None else [F.floor(i / wide).cast("int").alias("from"),
                                      F.floor(j / wide).cast("int").alias("to")]
    start_i, start_j = (i % CUT, j) if wide is None else (i % wide, j % wide)
    cut = F.floor(i / CUT).cast("int").alias("cut")
    return (inside.groupBy(*keys, *ranges, cut)
            .agg(F.collect_list(F.struct(start_i.cast("int").alias("i"),
                                         start_j.cast(number).alias("j"))).alias("e"))
            .select("*", "e.i", "e.j").drop("e"))


def packed_draws(perms: DataFrame, n_windows: int, wide: int) -> DataFrame:
    """(set, slot, range, new): where the windows of a range go in a draw, in their order."""
    slot = F.col("draw") + 1
    rows = perms.select(F.floor(slot / DRAWS_TOGETHER).cast("int").alias("set"),
                        (slot % DRAWS_TOGETHER).cast("int").alias("slot"),
                        F.floor(F.col("old") / wide).cast("int").alias("range"), "old", "new")
    number = T.IntegerType() if n_windows < 1 << 31 else T.LongType()
    schema = T.StructType([*(rows.schema[c] for c in ("set", "slot", "range")),
                           T.StructField("new", T.ArrayType(number))])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        old, new = (table.column(c).to_numpy() for c in ("old", "new"))
        ordered = pa.array(new[np.argsort(old)], to_arrow_type(number))
        return pa.table([pa.array([x.as_py()], pa.int32()) for x in key]
                        + [pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), ordered)],
                        schema.names)

    return rows.groupBy("set", "slot", "range").applyInArrow(pack, schema)


def moved_edges(b: DataFrame, keys: list[str], perms: DataFrame, n_draws: int,
                n_windows: int) -> DataFrame:
    """Edges of b under every draw, packed: (keys, target, set, j, code). ``target`` is the cut of the
    new i, ``code`` its place there and the place of the draw in its set; ``j`` is the new j."""
    wide = CUT * max(1, min(MOST_CUTS, -(-n_windows // (CUT * RANGES))))
    last = F.lit((n_windows - 1) // wide)
    edges = packed_edges(b, keys, n_windows, wide).drop("cut").select("*", _sets(n_draws))
    draws = written(packed_draws(perms, n_windows, wide), "draws")
    both = draws.select("set", "slot", "new", F.lit(True).alias("first"), F.col("range").alias("from"),
                        F.explode(F.sequence(F.lit(0), last)).alias("to")).unionByName(
        draws.select("set", "slot", "new", F.lit(False).alias("first"), F.col("range").alias("to"),
                     F.explode(F.sequence(F.lit(0), last)).alias("from")))
    number = draws.schema["new"].dataType
    schema = T.StructType([*(edges.schema[c] for c in keys), T.StructField("target", T.IntegerType()),
                           T.StructField("set", T.IntegerType()), T.StructField("j", number),
                           T.StructField("code", T.ArrayType(T.ShortType()))])

    def move(key: tuple, edges: pa.Table, draws: pa.Table) -> pa.Table:
        slots = draws.column("slot").to_pylist()
        first = draws.column("first").to_pylist()
        new = draws.column("new").combine_chunks()
        goes = {(s, f): new[n].values.to_numpy() for n, (s, f) in enumerate(zip(slots, first))}
        out = []
        for own, (i, j) in _lists(edges, keys, ["i", "j"]):
            some = sorted({s for s, _ in goes})
            if not some:
                continue
            to_i = np.concatenate([goes[s, True][i] for s in some])
            to_j = np.concatenate([goes[s, False][j] for s in some])
            target = to_i // CUT
            order = np.argsort(target.astype(np.uint16) if n_windows < CUT << 16 else target,
                               kind="stable")
            slot = np.repeat(np.array(some, np.int32), len(i))
            code = ((to_i % CUT) | (slot << CUT_BITS))[order].astype(np.uint16).view(np.int16)
            target = target[order]
            starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            cuts = pa.array(np.r_[starts, len(target)].astype(np.int32))
            out.append(pa.table(
                [pa.array([x] * len(starts), t) for x, t in zip(own, to_arrow_schema(schema).types)]
                + [pa.array(target[starts].astype(np.int32)), pa.repeat(key[-1], len(starts)),
                   pa.ListArray.from_arrays(cuts, pa.array(to_j[order])),
                   pa.ListArray.from_arrays(cuts, pa.array(code))], schema.names))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    by = ["from", "to", "set"]
    return edges.groupBy(*by).cogroup(both.groupBy(*by)).applyInArrow(move, schema)


def drawn_samples(population: DataFrame, keys: list[str], sizes: DataFrame, n: int,
                  n_draws: int, stream: int = 0) -> DataFrame:
    """Random sets of the given sizes, with replacement.

    ``sizes`` has (keys, size, first): ``first`` numbers the places so that different sets
    get different draws. ``population`` is keyed by ``w`` in 0..n-1.
    """
    return merged(drawn_places(keys, sizes, n, n_draws, stream), population, ["w"])


def drawn_places(keys: list[str], sizes: DataFrame, n: int, n_draws: int,
                 stream: int = 0) -> DataFrame:
    """(keys, draw, w): the windows that ``drawn_samples`` takes."""
    draws = F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))
    # a set of any size is laid out in parts, which are dealt out before their places are made
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"),
                                 F.floor((F.col("size") - 1) / PART).cast("bigint")))
    first, end = F.col("part") * PART, F.least((F.col("part") + 1) * PART, F.col("size"))
    places = F.explode(F.sequence(first, end - 1))
    return (sizes.filter("size > 0").select("*", draws.alias("draw")).select("*", parts.alias("part"))
            .repartition("draw", "first", "part").select("*", places.alias("m")).drop("part")
            .withColumn("w", draw_index(F.col("draw").cast("bigint"),
                                        F.col("first") + F.col("m"), n, stream))
            .select(*keys, "draw", "w"))


#: Windows and draws that meet in one task.
MEET_WINDOWS, MEET_DRAWS = 4096, 32


def drawn_moments(places: DataFrame, features: DataFrame, n_features: int, n_draws: int
                  ) -> DataFrame:
    """(draw, f, mean, var): moments of each feature over each draw's windows, NULLs left out.

    ``places`` (draw, w); ``features`` (w, x: array of doubles). A block of windows meets a few
    draws at a time: how often each draw takes each window, times the values and their squares,
    are two matrix products, so rows of draws never carry values. Values are taken from the mean
    of their feature, so that squares don't cancel.
    """
    block = F.floor(F.col("w") / MEET_WINDOWS).cast("bigint").alias("block")
    chunk = F.floor(F.col("draw") / MEET_DRAWS).cast("int").alias("chunk")
    means = features.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(
        F.avg("v").alias("mean"))
    # one row, as long as the list of features
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "mean"))),
                                   lambda m: F.coalesce(m["mean"], F.lit(0.0))).alias("c"))
    moved = attach(features, centre, []).select(
        "w", F.zip_with("x", "c", lambda v, c: v - c).alias("x"), block,
        F.explode(F.sequence(F.lit(0), F.lit((n_draws - 1) // MEET_DRAWS))).alias("chunk"))
    schema = T.StructType([T.StructField("draw", T.LongType())] + [
        T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("n", "s", "q")])

    def meet(key: tuple, taken: pa.Table, values: pa.Table) -> pa.Table:
        first, low = key[1].as_py() * MEET_DRAWS, key[0].as_py() * MEET_WINDOWS
        x = np.full((MEET_WINDOWS, n_features), np.nan)
        x[values.column("w").to_numpy() - low] = _matrix(values.column("x"))
        cell = ((taken.column("draw").to_numpy() - first) * MEET_WINDOWS
                + taken.column("w").to_numpy() - low)
        count = np.bincount(cell, minlength=MEET_DRAWS * MEET_WINDOWS).reshape(
            MEET_DRAWS, MEET_WINDOWS).astype(float)
        met = np.flatnonzero(count.any(axis=1))
        there, full = ~np.isnan(x), np.nan_to_num(x)
        sums = [count[met] @ m for m in (there.astype(float), full, full * full)]
        return pa.table([pa.array(met + first),
                         *(pa.array(list(m), pa.list_(pa.float64())) for m in sums)], schema.names)

    met = (places.select(F.col("draw").cast("long").alias("draw"), "w", block, chunk)
           .groupBy("block", "chunk").cogroup(moved.groupBy("block", "chunk"))
           .applyInArrow(meet, schema))
    total = (met.select("draw", F.posexplode(F.arrays_zip("n", "s", "q")).alias("f", "m"))
             .groupBy("draw", "f").agg(F.sum("m.n").alias("n"), F.sum("m.s").alias("s"),
                                       F.sum("m.q").alias("q")))
    mean = F.try_divide("s", "n")
    var = F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))
    # NULL where a draw met no value
    return (total.join(F.broadcast(means), "f")
            .select("draw", "f", (mean + F.col("mean")).alias("mean"),
                    F.when(F.col("n") > 0, var).alias("var")))


def two_sided(null: str, obs: str) -> Column:
    """2 * min(share above, share below), at most 1 (aggregate)."""
    above = F.avg(F.when(F.col(null) >= F.col(obs), 1.0).otherwise(0.0))
    below = F.avg(F.when(F.col(null) <= F.col(obs), 1.0).otherwise(0.0))
    return F.least(2 * F.least(above, below), F.lit(1.0))


def neighbour_enrichment(edges: DataFrame, features: DataFrame, names: list[str], n: int,
                         n_draws: int) -> DataFrame:
    """Per feature: neighbours against the population (standardised differences, AUC, KS), and
    their mean and variance against random sets.

    ``edges`` (i, j); ``features`` (w, one column per name) for w = 0..n-1.
    """
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"),
                                        F.col(x).cast("double").alias("v")) for x in names]))
    population = features.select("w", long.alias("f")).select("w", "f.feature", "f.v")
    pop = population.groupBy("feature").agg(
        F.avg("v").alias("pop_mean"), F.stddev_pop("v").alias("sd"), F.var_pop("v").alias("var"))
    members = edges.select(F.col("j").alias("w")).join(population, "w").select("feature", "v")
    both = members.withColumn("near", F.lit(True)).unionByName(
        population.select("feature", "v", F.lit(False).alias("near")))
    is_near = F.col("near")
    contrast = (stats.cohens_d(both, ["feature"], "v", is_near)
                .join(stats.cles_auc(both, ["feature"], "v", is_near), "feature")
                .join(stats.ks_stat(both, ["feature"], "v", is_near), "feature"))
    near = members.groupBy("feature").agg(
        F.count("v").alias("n_neighbours"),
        F.round(F.avg("v"), TIE_DIGITS).alias("obs_mean"),
        F.round(F.var_pop("v"), TIE_DIGITS).alias("obs_var"))
    total = edges.agg(F.count(F.lit(1)).alias("size")).withColumn("first", F.lit(0).cast("bigint"))
    wide = features.select("w", F.array(*[F.col(x).cast("double") for x in names]).alias("x"))
    null = drawn_moments(drawn_places([], total, n, n_draws), wide, len(names), n_draws).select(
        F.element_at(F.array(*[F.lit(x) for x in names]), F.col("f") + 1).alias("feature"), "draw",
        F.round("mean", TIE_DIGITS).alias("null_mean"),
        F.round("var", TIE_DIGITS).alias("null_var"))
    joined = null.join(near, "feature")
    p = joined.groupBy("feature").agg(two_sided("null_mean", "obs_mean").alias("p_mean"),
                                      two_sided("null_var", "obs_var").alias("p_var"))
    return near.join(pop, "feature").join(p, "feature").join(contrast, "feature").select(
        "feature", "n_neighbours",
        ((F.col("obs_mean") - F.col("pop_mean")) / (F.col("sd") + F.lit(1e-12)))
        .alias("mean_shift_sigma"),
        (F.col("obs_var") / (F.col("var") + F.lit(1e-12))).alias("var_ratio"), "cohens_d", "auc",
        "ks", "p_mean", "p_var")


def usable_sets(edges: DataFrame, min_n: int = 2) -> DataFrame:
    """(i, size, first): anchors with enough neighbours, places numbered by anchor."""
    return (edges.groupBy("i").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_n)
            .withColumn("first", F.col("i") * 1000003))


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rounded median per key; a key has a value per window, so it is spread over tasks."""
    m = quantiles(df, keys, value, {name: 0.5}, by_ratio)
    return m.withColumn(name, F.round(name, TIE_DIGITS))


def varratio(edges: DataFrame, features: DataFrame, names: list[str], n: int, n_draws: int,
             min_n: int = 2) -> DataFrame:
    """Median over anchors of neighbour variance / overall variance, with one-sided p and its
    q among the features."""
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"),
                                        F.col(x).cast("double").alias("v")) for x in names]))
    population = features.select("w", long.alias("f")).select("w", "f.feature", "f.v")
    overall = population.groupBy("feature").agg((F.var_samp("v") + F.lit(1e-12)).alias("gv"))
    sets = usable_sets(edges, min_n)

    def median_ratio(members: DataFrame, extra: list[str], name: str) -> DataFrame:
        per = members.groupBy(*extra, "feature", "i").agg(F.var_samp("v").alias("var"))
        # read for ranges, medians and counts
        ratio = written(per.join(overall, "feature").select(
            *extra, "feature", (F.col("var") / F.col("gv")).alias("ratio")), "variance-ratios")
        keys = [*extra, "feature"]
        return (medians(ratio, keys, "ratio", name)
                .join(ratio.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used")), keys))

    used = merged(edges, sets.select("i"), ["i"]).select("i", F.col("j").alias("w"))
    near = merged(used, population, ["w"])
    obs = median_ratio(near, [], "median_ratio").filter("n_used >= 3")
    null = median_ratio(drawn_samples(population, ["i"], sets, n, n_draws), ["draw"],
                        "null_ratio").drop("n_used")
    below = F.sum(F.when(F.col("null_ratio") <= F.col("median_ratio"), 1).otherwise(0))
    tested = (obs.join(null, "feature").groupBy("feature", "n_used")
              .agg(F.max("median_ratio").alias("median_ratio"),
                   ((below + 1) / F.lit(n_draws + 1.0)).alias("p")))
    # one row a feature: the features are few and named in the call
    every = Window.partitionBy()
    larger = Window.orderBy(F.desc("p"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.col("p") * F.count(F.lit(1)).over(every) / F.row_number().over(
        Window.orderBy("p", F.desc("feature")))
    return tested.withColumn("__s", scaled).withColumn(
        "q", F.least(F.min("__s").over(larger), F.lit(1.0))).drop("__s")


def trace_cov(members: DataFrame, keys: list[str]) -> DataFrame:
    """Trace of the sample covariance of each small set of vectors."""
    held = F.collect_list(F.col("vec").cast("array<double>"))
    n = F.size("__v").cast("double")
    zero = F.lit(0.0)
    sq = F.aggregate("__v", zero, lambda acc, v: acc + F.aggregate(
        v, zero, lambda s, x: s + x * x))
    total_sq = F.aggregate(vector_sum(F.col("__v")), zero, lambda s, x: s + x * x)
    # members of a set come from anywhere: gathering them before they are dealt out would only sort
    return members.repartition(*keys).groupBy(*keys).agg(held.alias("__v")).select(
        *keys, ((sq - total_sq / n) / (n - 1)).alias("trace"))


def trace_cov_ratio(edges: DataFrame, emb: DataFrame, n: int, n_draws: int,
                    min_n: int = 2) -> DataFrame:
    """As ``varratio`` for a vector: trace of the neighbours' covariance over the overall one."""
    vectors = emb.select("w", "vec")
    elements = vectors.select(F.posexplode(F.col("vec").cast("array<double>")))
    overall = elements.groupBy("pos").agg(F.var_samp("col").alias("v")).agg(
        (F.sum("v") + F.lit(1e-12)).alias("gtv"))
    sets = usable_sets(edges, min_n)
    members = merged(edges, sets.select("i"), ["i"]).select("i", F.col("j").alias("w"))
    near = merged(members, vectors, ["w"])
    near = trace_cov(near, ["i"]).select(F.lit(-1).alias("draw"), "i", "trace")
    drawn = trace_cov(drawn_samples(vectors, ["i"], sets, n, n_draws), ["draw", "i"])
    # read for ranges and medians, of the draws and of what was observed
    ratio = written(attach(near.unionByName(drawn), overall, []).select(
        "draw", (F.col("trace") / F.col("gtv")).alias("ratio")), "trace-ratios")
    med = medians(ratio, ["draw"], "ratio", "m")
    obs = med.filter("draw = -1").select(F.col("m").alias("median_ratio"))
    used = sets.agg(F.count(F.lit(1)).alias("n_used"))
    below = F.sum(F.when(F.col("m") <= F.col("median_ratio"), 1).otherwise(0))
    return attach(attach(med.filter("draw >= 0"), obs, []), used, []).groupBy(
        "median_ratio", "n_used").agg(((below + 1) / F.lit(n_draws + 1.0)).alias("p"))
