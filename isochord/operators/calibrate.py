"""Calibrating an observed score against its null rotations or permutations.

A curve is first folded into counts per (keys, score). mKNN scores take few distinct
values, so this map-side aggregation removes nearly all rows before the shuffle, however
many rotations or draws one key holds; order statistics then come from running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochord.functions.vectors import signed_shift


def folded(curve: DataFrame, keys: list[str], is_obs: Column, in_null: Column) -> DataFrame:
    """Counts per distinct score, running null counts and the observed score.

    A NULL score (of a curve that could not be standardised, say) counts for nothing.
    """
    given = F.col("score").isNotNull()
    is_obs, in_null = given & is_obs, given & in_null
    w = Window.partitionBy(*keys)
    upto = w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    return (curve.groupBy(*keys, "score")
            .agg(F.count_if(is_obs).alias("n_obs"), F.count_if(in_null).alias("n_null"))
            .withColumn("obs", F.max(F.when(F.col("n_obs") > 0, F.col("score"))).over(w))
            .withColumn("cum_null", F.sum("n_null").over(upto))
            .withColumn("cum_all", F.sum(F.col("n_null") + F.col("n_obs")).over(upto))
            .withColumn("total_null", F.sum("n_null").over(w)))


def null_mean() -> Column:
    return F.try_divide(F.sum(F.col("score") * F.col("n_null")), F.sum("n_null"))


def null_sd() -> Column:
    """Sample standard deviation of the null from counts, around its own mean; NULL below two."""
    squares = F.sum(F.col("n_null") * F.pow(F.col("score") - F.col("mu"), F.lit(2)))
    return F.sqrt(F.try_divide(squares, F.sum("n_null") - 1))


def rank_p(extra: int = 0) -> Column:
    """(1 + extra + null scores at or above the observed) / (1 + extra + null scores); NULL
    without an observed score (an aggregate)."""
    p = (1 + extra + at_or_above()) / (F.max("total_null") + 1 + extra)
    return F.when(F.max("obs").isNotNull(), p)


def at_or_above() -> Column:
    return F.sum(F.when(F.col("score") >= F.col("obs"), F.col("n_null")).otherwise(0))


def order_statistic_index(alpha: float, n_null: int) -> int:
    """1-based rank of the threshold inside {observed} and the null."""
    return min(math.ceil((1 - alpha) * (n_null + 1)), n_null + 1)


def calibrate_cyclic(curve: DataFrame, keys: list[str], n_windows: int,
                     alpha: float = 0.05) -> DataFrame:
    """Observed score, order-statistic threshold, clamped calibrated score, p, excess.

    The null is every rotation but the identity; tau is taken over null and observed
    together, unlike :func:`calibrate_linear`.
    """
    rank = order_statistic_index(alpha, n_windows - 1)
    f = folded(curve, keys, F.col("d") == 0, F.col("d") != 0)
    tau, obs = F.col("tau"), F.col("obs")
    return (f.groupBy(*keys).agg(
                F.max("obs").alias("obs"),
                F.min(F.when(F.col("cum_all") >= rank, F.col("score"))).alias("tau"),
                null_mean().alias("null_mean"),
                rank_p().alias("p"))
            .select(*keys, "obs", "tau",
                    F.when(tau < 1, F.greatest((obs - tau) / (1 - tau), F.lit(0.0)))
                    .otherwise(0.0).alias("s_cal"),
                    "p", "null_mean", (obs - F.col("null_mean")).alias("excess")))


def linear_quantile() -> Column:
    """Interpolated null quantile at position ``h``, from running counts (an aggregate)."""
    real = F.col("n_null") > 0
    low = F.min(F.when(real & (F.col("cum_null") > F.floor("h")), F.col("score")))
    high = F.min(F.when(real & (F.col("cum_null") > F.ceil("h")), F.col("score")))
    return low + (F.max("h") - F.floor(F.max("h"))) * (high - low)


def with_position(f: DataFrame, q: float) -> DataFrame:
    """Adds the fractional 0-based position of quantile ``q``, rounded off float noise."""
    return f.withColumn("h", F.round((F.col("total_null") - 1) * F.lit(q), 9))


def calibrate_linear(curve: DataFrame, keys: list[str], is_obs: Column, in_null: Column,
                     alpha: float = 0.05) -> DataFrame:
    """As the permutation test does it: tau is the interpolated 1-alpha null quantile."""
    f = with_position(folded(curve, keys, is_obs, in_null), 1 - alpha)
    tau, obs = F.col("tau"), F.col("obs")
    return (f.groupBy(*keys).agg(
                F.max("obs").alias("obs"), linear_quantile().alias("tau"),
                null_mean().alias("null_mean"),
                rank_p().alias("p"))
            .select(*keys, "obs", "tau",
                    F.when(tau < 1, F.greatest(obs - tau, F.lit(0.0)) / (1 - tau))
                    .otherwise(0.0).alias("s_cal"), "p", "null_mean"))


def null_percentiles(curve: DataFrame, keys: list[str], in_null: Column,
                     probs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of the null, one column per entry of ``probs``."""
    f = folded(curve, keys, F.lit(False), in_null)
    out = None
    for name, q in probs.items():
        one = (with_position(f, q).groupBy(*keys)
               .agg(linear_quantile().alias(name)))
        out = one if out is None else out.join(one, keys)
    return out


def in_tail(n_windows: int, tail_min: int) -> Column:
    """Rotations at least ``tail_min`` windows away; all but the identity if not positive."""
    if tail_min <= 0:
        return F.col("d") != 0
    return F.abs(signed_shift(F.col("d"), n_windows)) >= tail_min


def tail_stats(curve: DataFrame, keys: list[str], n_windows: int,
               tail_min: int = 100) -> DataFrame:
    """Observed score against far rotations: mean, sd, z and p with a 2/(n+2) floor.

    A recording too short to have far rotations has no mean, sd or z; its p is 1.
    """
    tail = in_tail(n_windows, tail_min)
    f = folded(curve, keys, F.col("d") == 0, tail)
    w = Window.partitionBy(*keys)
    f = f.withColumn("mu", F.try_divide(F.sum(F.col("score") * F.col("n_null")).over(w),
                                        F.col("total_null")))
    return (f.groupBy(*keys).agg(
                F.max("obs").alias("obs"), F.max("mu").alias("tail_mean"),
                null_sd().alias("tail_sd"),
                F.max("total_null").cast("bigint").alias("n_tail"),
                rank_p(1).alias("p_tail"))
            .withColumn("z_tail", F.when(F.col("tail_sd") > 0,
                                         (F.col("obs") - F.col("tail_mean"))
                                         / F.col("tail_sd"))))


def shift_pvalues(curve: DataFrame, keys: list[str], n_windows: int,
                  tail_min: int = 100) -> DataFrame:
    """Whole-grid p, tail p, tail moments and the drift slope over signed shifts."""
    whole = curve.withColumn("x", signed_shift(F.col("d"), n_windows).cast("double"))
    slope = whole.groupBy(*keys).agg(
        F.regr_slope(F.col("score"), F.col("x")).alias("slope"))
    grid = grid_p(curve, keys, F.col("d") == 0).select(*keys, F.col("p").alias("p_all"))
    return (tail_stats(curve, keys, n_windows, tail_min)
            .join(grid, keys).join(slope, keys))


def grid_p(curve: DataFrame, keys: list[str], is_obs: Column) -> DataFrame:
    """Rank of the observed score among all scores of the grid, itself included."""
    return folded(curve, keys, is_obs, F.lit(True)).groupBy(*keys).agg(
        F.max("obs").alias("obs"), rank_p().alias("p"))


def mean_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Subject-mean curve."""
    return curve.groupBy(*keys, "d").agg(F.avg("score").alias("score"))


def zscored_curve(curve: DataFrame, keys: list[str], n_windows: int,
                  tail_min: int) -> DataFrame:
    """Each curve standardised against its own far rotations; NULL where these do not vary."""
    tail = in_tail(n_windows, tail_min)
    stats = curve.filter(tail).groupBy(*keys).agg(
        F.avg("score").alias("mu"), F.stddev_samp("score").alias("sd"))
    return (curve.join(stats, keys)
            .select(*keys, "d", F.try_divide(F.col("score") - F.col("mu"), F.col("sd"))
                    .alias("score")))


def family_mean_z(curve: DataFrame, member: list[str], family: list[str],
                  n_windows: int, tail_min: int) -> DataFrame:
    """Mean z over a family's sizes at every rotation, and the rank of the identity."""
    z = zscored_curve(curve, [*family, *member], n_windows, tail_min)
    per_d = z.groupBy(*family, "d").agg(F.round(F.avg("score"), 12).alias("score"))
    f = folded(per_d, family, F.col("d") == 0, in_tail(n_windows, tail_min))
    return f.groupBy(*family).agg(
        F.max("obs").alias("zbar"),
        rank_p(1).alias("p"))


def slope_null(curve: DataFrame, family: list[str], rank: str, n_windows: int,
               tail_min: int) -> DataFrame:
    """Slope of the score over size rank, against the same slope at far rotations."""
    size = F.col(rank).cast("double")
    per_d = (curve.groupBy(*family, "d")
             .agg(F.round(F.regr_slope(F.col("score"), size), 12).alias("score"),
                  F.count(F.lit(1)).alias("n_sizes"))
             .filter(F.col("n_sizes") >= 2))
    f = folded(per_d, family, F.col("d") == 0, in_tail(n_windows, tail_min))
    return f.groupBy(*family).agg(
        F.max("obs").alias("slope"),
        rank_p().alias("p_slope"))
