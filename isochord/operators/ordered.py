"""Ranks, running totals and running extremes over a whole table, in parallel.

A window ordered over everything would run in one task. Here rows are first folded to one
per distinct value (map-side), values are cut into ranges at fixed bounds, totals are
accumulated inside each range, and the few range totals are accumulated in turn and added.
The result is exact whatever the bounds are; the bounds only balance the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds per-key totals to every row; without keys ``totals`` is a single row."""
    return df.join(totals, keys) if keys else df.join(F.broadcast(totals))


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input: sorted and merged at every size.

    Rows that a task makes from others (neighbours, draws, shifts) count as few in the planner's
    estimate, which would send millions of them to the driver to be broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def values_bounds(df: DataFrame, values: list[str]) -> list[list[float]]:
    """Approximate quantiles of several columns in one pass, as range bounds.

    As many ranges as shuffle partitions; this small list is all the driver sees.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.stat.approxQuantile(values, [i / n for i in range(1, n)], 0.01)
    return [sorted(set(f)) for f in found]


def value_bounds(df: DataFrame, value: str) -> list[float]:
    return values_bounds(df, [value])[0]


def by_ratio(value: Column) -> Column:
    """Ranges for positive values: a thousandth of an octave each, however many there are."""
    return F.floor(F.log2(F.greatest(value, F.lit(1e-300))) * 1000).cast("long")


def range_of(value: Column, bounds: list[float] | Callable[[Column], Column]) -> Column:
    """Number of bounds below the value, by bisection, or what a rising function says;
    NULL-free because values are."""
    if callable(bounds):
        return bounds(value)

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(float(bounds[mid])), among(lo, mid)).otherwise(
            among(mid + 1, hi))
    return among(0, len(bounds))


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, str],
            bounds: list[float] | Callable[[Column], Column], descending: bool = False) -> DataFrame:
    """Inclusive running sums along ``value``, whose values are unique within ``keys``.

    ``sums`` maps a new column to the column it accumulates; the totals over all values
    of the key come as ``<new column>_all``.
    """
    cut = df.withColumn("__range", range_of(F.col(value), bounds))
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (Window.partitionBy(*keys, "__range").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0))
    r_order = F.col("__range").desc() if descending else F.col("__range").asc()
    before = (Window.partitionBy(*keys).orderBy(r_order)
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys)

    totals = cut.groupBy(*keys, "__range").agg(
        *[F.sum(src).alias(f"__t_{new}") for new, src in sums.items()])
    offsets = totals.select(
        *keys, "__range",
        *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}")
          for new in sums],
        *[F.sum(f"__t_{new}").over(whole).alias(f"{new}_all") for new in sums])
    local = cut.select(
        "*", *[F.sum(src).over(inside).alias(f"__l_{new}") for new, src in sums.items()])
    return local.join(offsets, [*keys, "__range"]).select(
        *df.columns,
        *[(F.col(f"__l_{new}") + F.col(f"__o_{new}")).alias(new) for new in sums],
        *[F.col(f"{new}_all") for new in sums])


def running_min(df: DataFrame, value: str, measure: str, bounds: list[float],
                name: str) -> DataFrame:
    """Minimum of ``measure`` over this and all larger values."""
    cut = df.withColumn("__range", range_of(F.col(value), bounds))
    inside = (Window.partitionBy("__range").orderBy(F.col(value).desc())
              .rowsBetween(Window.unboundedPreceding, 0))
    above = (Window.partitionBy("__one").orderBy(F.col("__range").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    # one row per range: at most len(bounds) + 1 of them
    offsets = (cut.groupBy("__range").agg(F.min(measure).alias("__m"))
               .withColumn("__one", F.lit(1))
               .select("__range", F.min("__m").over(above).alias("__a")))
    return (cut.withColumn("__l", F.min(measure).over(inside))
            .join(offsets, "__range")
            .select(*df.columns, F.least("__l", "__a").alias(name)))


def value_counts(df: DataFrame, keys: list[str], value: str,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value: count ``n`` and any further aggregates."""
    more = [c.alias(name) for name, c in (extra or {}).items()]
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *more)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str,
                  bounds: list[float] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, value, n, average rank of the tied group), one row per distinct value.

    Rows that are counts already say so by their ``weight``.
    """
    bounds = value_bounds(df, value) if bounds is None else bounds
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    run = running(df.groupBy(*keys, value).agg(n.alias("n")), keys, value, {"__cum": "n"}, bounds)
    return run.select(*keys, value, "n",
                      (F.col("__cum") - (F.col("n") - 1) / 2.0).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              bounds: list[float] | Callable[[Column], Column] | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    Equal to an exact percentile aggregate, but no task holds the values of a whole key.
    """
    df = df.select(*keys, value).filter(F.col(value).isNotNull())
    bounds = value_bounds(df, value) if bounds is None else bounds
    run = running(value_counts(df, keys, value), keys, value, {"__cum": "n"}, bounds)

    def at(q):
        # rounded, so that a whole position is not missed by float noise
        h = F.round((F.col("__cum_all") - 1) * F.lit(q), 9)
        return h, F.floor(h), F.ceil(h)

    aggs, out = [], []
    for name, q in probs.items():
        h, lo, hi = at(q)
        aggs += [F.min(F.when(F.col("__cum") > lo, F.col(value))).alias(f"__lo_{name}"),
                 F.min(F.when(F.col("__cum") > hi, F.col(value))).alias(f"__hi_{name}"),
                 F.max(h - lo).alias(f"__f_{name}")]
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + F.col(f"__f_{name}") * (high - low)).alias(name))
    return run.groupBy(*keys).agg(*aggs).select(*keys, *out)
