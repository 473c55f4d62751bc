"""Effect sizes, concentration, rank and regression statistics.

Everything is expressed through sums over rows or over distinct values, so a dominant
group is folded by all map tasks before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.functions.dist import t_pvalue
from isochord.functions.vectors import missing_to_null
from isochord.operators.ordered import (attach, average_ranks, quantiles, running, running_min,
                                        value_bounds, value_counts, values_bounds)


# -- two-sample contrasts ------------------------------------------------------------

def _moment_contrast(values: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    v = F.col(value)
    return values.groupBy(*keys).agg(
        F.count(F.when(is_a, v)).alias("n_a"), F.count(F.when(~is_a, v)).alias("n_b"),
        F.avg(F.when(is_a, v)).alias("mean_a"), F.avg(F.when(~is_a, v)).alias("mean_b"),
        F.var_samp(F.when(is_a, v)).alias("var_a"),
        F.var_samp(F.when(~is_a, v)).alias("var_b"))


def cohens_d(values: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """Standardised mean difference with the pooled sample variance."""
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                    / F.greatest(F.col("n_a") + F.col("n_b") - 2, F.lit(1)))
    return _moment_contrast(values, keys, value, is_a).select(
        *keys, ((F.col("mean_a") - F.col("mean_b")) / (pooled + F.lit(1e-12)))
        .alias("cohens_d"))


def _two_sample_counts(values: DataFrame, keys: list[str], value: str, is_a: Column,
                       bounds: list[float] | None) -> DataFrame:
    """Per distinct value: counts and running counts of both samples."""
    bounds = value_bounds(values, value) if bounds is None else bounds
    per = value_counts(values.filter(F.col(value).isNotNull()), keys, value,
                       {"a": F.count_if(is_a), "b": F.count_if(~is_a)})
    return running(per, keys, value, {"cum_a": "a", "cum_b": "b"}, bounds)


def cles_auc(values: DataFrame, keys: list[str], value: str, is_a: Column,
             bounds: list[float] | None = None) -> DataFrame:
    """P(a > b) with ties counted half; NULL where a sample is empty."""
    c = _two_sample_counts(values, keys, value, is_a, bounds)
    wins = F.sum(F.col("a").cast("double") * (F.col("cum_b") - F.col("b") + F.col("b") / 2.0))
    n_a, n_b = F.max("cum_a_all").cast("double"), F.max("cum_b_all").cast("double")
    return c.groupBy(*keys).agg(F.when((n_a > 0) & (n_b > 0), wins / (n_a * n_b)).alias("auc"))


def ks_stat(values: DataFrame, keys: list[str], value: str, is_a: Column,
            bounds: list[float] | None = None) -> DataFrame:
    """Largest gap between the two empirical distribution functions; NULL with a sample empty."""
    c = _two_sample_counts(values, keys, value, is_a, bounds)
    gap = F.abs(F.try_divide("cum_a", "cum_a_all") - F.try_divide("cum_b", "cum_b_all"))
    return c.groupBy(*keys).agg(F.max(gap).alias("ks"))


# -- concentration -------------------------------------------------------------------

def gini(df: DataFrame, keys: list[str], value: str,
         bounds: list[float] | None = None) -> DataFrame:
    """Gini coefficient; a negative minimum is shifted to zero, a zero total gives 0."""
    bounds = value_bounds(df, value) if bounds is None else bounds
    run = running(value_counts(df.filter(F.col(value).isNotNull()), keys, value),
                  keys, value, {"cum": "n"}, bounds)
    low = run.groupBy(*keys).agg(F.min(value).alias("low"))
    run = attach(run, low, keys)
    x = F.col(value) - F.when(F.col("low") < 0, F.col("low")).otherwise(F.lit(0.0))
    # a value of rank r enters the cumulative sums of all ranks from r to n
    n, cum, total = F.col("n"), F.col("cum"), F.max("cum_all")
    rank_sum = n * (cum - n) + n * (n + 1) / 2.0
    per = run.groupBy(*keys).agg(
        F.sum(x * (n * (F.col("cum_all") + 1) - rank_sum)).alias("cum_sums"),
        F.sum(x * n).alias("sum_x"), total.alias("n_all"))
    return per.select(*keys, F.when(
        F.col("sum_x") > 0,
        (F.col("n_all") + 1 - 2 * F.col("cum_sums") / F.col("sum_x")) / F.col("n_all"))
        .otherwise(0.0).alias("gini"))


def lorenz(df: DataFrame, keys: list[str], value: str,
           bounds: list[float] | None = None) -> DataFrame:
    """Concentration curve, largest first, one point per distinct value.

    ``frac`` is the share of rows down to and including the value, ``share`` the share of
    the total they carry; points inside a tie lie on the straight line between.
    """
    df = df.filter(F.col(value).isNotNull()).withColumn(
        value, F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    bounds = value_bounds(df, value) if bounds is None else bounds
    per = value_counts(df, keys, value).withColumn("carried", F.col("n") * F.col(value))
    run = running(per, keys, value, {"cum_n": "n", "cum": "carried"}, bounds, descending=True)
    return run.select(
        *keys, value, "n", (F.col("cum_n") / F.col("cum_n_all")).alias("frac"),
        F.when(F.col("cum_all") > 0, F.col("cum") / F.col("cum_all"))
        .otherwise(F.col("cum")).alias("share"))


# -- multiple testing ----------------------------------------------------------------

def benjamini_hochberg(df: DataFrame, p: str, bounds: list[float] | None = None) -> DataFrame:
    """All rows with their q-value; NULL and NaN p stay NULL and are not counted."""
    clean = F.when(~F.isnan(F.col(p)), F.col(p))
    given = df.select(clean.alias(p)).filter(F.col(p).isNotNull())
    bounds = value_bounds(given, p) if bounds is None else bounds
    run = running(value_counts(given, [], p), [], p, {"cum": "n"}, bounds)
    # within a tie the largest rank gives the smallest ratio
    raw = run.withColumn("ratio", F.col(p) * F.col("cum_all") / F.col("cum"))
    q = running_min(raw, p, "ratio", bounds, "q").select(
        F.col(p), F.least("q", F.lit(1.0)).alias("q"))
    return df.withColumn(p, clean).join(q, p, "left")


# -- correlation and regression ------------------------------------------------------

def spearman(df: DataFrame, keys: list[str], x: str, y: str,
             bounds_x: list[float] | None = None,
             bounds_y: list[float] | None = None) -> DataFrame:
    """Average-rank correlation with its two-sided Student-t p-value."""
    d = df.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if bounds_x is None or bounds_y is None:
        bounds_x, bounds_y = values_bounds(d, [x, y])
    # one exchange of the joint counts serves both rankings and the sums
    joint = d.groupBy(*keys, x, y).agg(F.count(F.lit(1)).cast("double").alias("m"))
    rx = average_ranks(joint, keys, x, "rx", bounds_x, "m").drop("n")
    ry = average_ranks(joint, keys, y, "ry", bounds_y, "m").drop("n")
    both = joint.join(rx, [*keys, x]).join(ry, [*keys, y])
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    s = both.groupBy(*keys).agg(
        F.sum(m).alias("n"), F.sum(m * a).alias("sa"), F.sum(m * b).alias("sb"),
        F.sum(m * a * b).alias("sab"), F.sum(m * a * a).alias("saa"),
        F.sum(m * b * b).alias("sbb"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    s = s.withColumn("rho", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)))
    rho = F.col("rho")
    t = F.when(F.abs(rho) < 1, rho * F.sqrt((n - 2) / (1 - rho * rho)))
    p = F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_pvalue(t, n - 2))
    return s.select(*keys, n.cast("bigint").alias("n"), "rho", p.alias("p"))


def ols_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"))


def r2_from_corr(y: str, x1: str, x2: str | None = None) -> Column:
    """R^2 of y on one or two predictors with intercept (an aggregate expression)."""
    r1 = F.corr(y, x1)
    if x2 is None:
        return r1 * r1
    r2, r12 = F.corr(y, x2), F.corr(x1, x2)
    joint = (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12)
    return F.when(F.abs(r12) < 1, joint).otherwise(r1 * r1)


def variance_partition_2(df: DataFrame, keys: list[str], y: str, x1: str,
                         x2: str) -> DataFrame:
    """R^2 of each predictor, of both, and what each adds to the other."""
    d = df.groupBy(*keys).agg(r2_from_corr(y, x1).alias("r2_1"), r2_from_corr(y, x2).alias("r2_2"),
                              r2_from_corr(y, x1, x2).alias("r2_full"))
    return d.withColumn("unique_1", F.col("r2_full") - F.col("r2_2")) \
            .withColumn("unique_2", F.col("r2_full") - F.col("r2_1"))


def partial_corr_1(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y after removing z; 0 where nothing is left of either."""
    d = df.groupBy(*keys).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"),
                              F.corr(y, z).alias("yz"))
    left = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    value = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(left)
    return d.select(*keys, F.when(left > 1e-24, value).otherwise(0.0).alias("partial_corr"))


def covariances(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, cov): the covariance matrix of rows without NULLs, row by row, per key.

    Partial sums meet before the shuffle; one row a key travels on.
    """
    d = df.select(*keys, *columns).dropna(subset=columns)
    cells = [F.covar_pop(a, b) for a in columns for b in columns]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("cov"))


def _from_covariances(df: DataFrame, keys: list[str], columns: list[str], names: list[str],
                      solve) -> DataFrame:
    """Applies ``solve`` (matrix -> numbers) to the covariance matrix of each key."""
    sums = covariances(df, keys, columns)
    schema = T.StructType([*(sums.schema[k] for k in [*keys, "n"]),
                           *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches):
        for pdf in batches:
            rows = [solve(np.reshape(c, (len(columns), len(columns)))) for c in pdf["cov"]]
            out = pd.DataFrame(rows, columns=names, index=pdf.index, dtype="float64")
            yield pd.concat([pdf[[*keys, "n"]], out], axis=1)

    return sums.mapInPandas(run, schema)


def _explained(cov: np.ndarray, at: list[int]) -> float:
    """R^2 of column 0 on the columns ``at``, which may depend on each other."""
    if not at or cov[0, 0] <= 0:
        return 0.0
    c = cov[at, 0]
    return float(c @ np.linalg.pinv(cov[np.ix_(at, at)], hermitian=True) @ c / cov[0, 0])


def variance_partition(df: DataFrame, keys: list[str], y: str,
                       blocks: dict[str, list[str]]) -> DataFrame:
    """R^2 of each block of predictors, of all together, and what each adds to the others."""
    columns = [y, *dict.fromkeys(c for b in blocks.values() for c in b)]
    at = {name: [columns.index(c) for c in b] for name, b in blocks.items()}
    every = sorted({i for b in at.values() for i in b})

    def solve(cov):
        full = _explained(cov, every)
        alone = [_explained(cov, b) for b in at.values()]
        rest = [sorted({i for other, b in at.items() if other != name for i in b}) for name in at]
        return [full, *alone, *(full - _explained(cov, r) for r in rest)]
    names = ["r2_full", *(f"r2_{b}" for b in blocks), *(f"unique_{b}" for b in blocks)]
    return _from_covariances(df, keys, columns, names, solve)


def partial_corr(df: DataFrame, keys: list[str], x: str, y: str,
                 controls: list[str]) -> DataFrame:
    """Correlation of x and y after removing any number of controls; 0 if nothing is left."""
    columns = [x, y, *controls]

    def solve(cov):
        a, b, z = cov[:2, :2], cov[:2, 2:], cov[2:, 2:]
        left = a - b @ np.linalg.pinv(z, hermitian=True) @ b.T if controls else a
        scale = left[0, 0] * left[1, 1]
        return [left[0, 1] / np.sqrt(scale) if scale > 1e-24 * a[0, 0] * a[1, 1] else 0.0]
    return _from_covariances(df, keys, columns, ["partial_corr"], solve)


def ancova(df: DataFrame, family: str, x: str, y: str) -> DataFrame:
    """Slope of y on x within families, partial eta squared, p, and the raw slope.

    By Frisch-Waugh the adjusted slope is the slope of the family-demeaned columns, so
    per-family sums are enough. Where x does not vary (within families, for the adjusted one) a
    slope is NULL, and so is what follows from it.
    """
    d = df.select(family, x, y).filter(
        F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(family).isNotNull())
    n = F.count(F.lit(1)).cast("double")
    fam = d.groupBy(family).agg(
        n.alias("n"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    c = F.col("n")
    tot = fam.agg(
        F.sum(c).alias("n"), F.count(F.lit(1)).alias("n_fam"), F.sum(c * F.col("cxy")).alias("sxy"),
        F.sum(c * F.col("vx")).alias("sxx"), F.sum(c * F.col("vy")).alias("syy"),
        F.sum(c * F.col("mx")).alias("bx"), F.sum(c * F.col("my")).alias("by"),
        F.sum(c * F.col("mx") * F.col("my")).alias("bxy"),
        F.sum(c * F.col("mx") * F.col("mx")).alias("bxx"))
    n, one = F.col("n"), F.col("n_fam") < 2
    raw = F.try_divide(
        F.col("sxy") + F.try_divide(n * F.col("bxy") - F.col("bx") * F.col("by"), n),
        F.col("sxx") + F.try_divide(n * F.col("bxx") - F.col("bx") * F.col("bx"), n))
    adj = F.try_divide("sxy", "sxx")
    ss = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    sse = F.greatest(F.col("syy") - ss, F.lit(0.0))
    dof = n - F.col("n_fam") - 1
    t = F.try_divide(adj, F.sqrt(F.try_divide(sse, F.greatest(dof, F.lit(0.0)) * F.col("sxx"))))
    enough = n >= 4
    return tot.select(
        n.cast("bigint").alias("n"), F.when(enough, raw).alias("slope_unadj"),
        F.when(enough, F.when(one, raw).otherwise(adj)).alias("slope_adj"),
        F.when(enough & ~one, ss / (ss + sse + F.lit(1e-12))).alias("partial_eta2"),
        F.when(enough & ~one, t).alias("t"), F.when(enough & ~one, dof).alias("dof")) \
        .withColumn("p", t_pvalue(F.col("t"), F.col("dof"))).drop("dof")


# -- centring, scaling ---------------------------------------------------------------

def centred(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Value minus its group mean; the mean is aggregated first, then joined back."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    return (df.join(means, keys).withColumn(name, F.col(value) - F.col("__mean"))
            .drop("__mean"))


def paired_sem(df: DataFrame, subject: str, model: str, value: str) -> DataFrame:
    """Standard error per model, plain and with each subject's own mean removed."""
    d = centred(df, [subject], value, "__r")
    root = F.sqrt(F.count(value))
    return d.groupBy(model).agg(F.avg(value).alias("mean"),
                                (F.stddev_samp(value) / root).alias("sem"),
                                (F.stddev_samp("__r") / root).alias("sem_paired"))


def zscored(df: DataFrame, keys: list[str], value: str, name: str, eps: float = 1e-8,
            flat: float | None = None, limit: float | None = None) -> DataFrame:
    """Standardised within ``keys`` by population moments.

    With ``flat`` a deviation below it counts as 1 (instead of adding ``eps``);
    ``limit`` clips the result.
    """
    sd = F.stddev_pop(value)
    scale = F.when(sd < flat, 1.0).otherwise(sd) if flat is not None else sd + F.lit(eps)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mu"), scale.alias("__sd"))
    joined = attach(df, stats, keys)
    z = (F.col(value) - F.col("__mu")) / F.col("__sd")
    if limit is not None:
        z = F.greatest(F.least(z, F.lit(float(limit))), F.lit(-float(limit)))
    return joined.withColumn(name, z).drop("__mu", "__sd")


def iqr_scaled(df: DataFrame, keys: list[str], value: str, name: str, limit: float = 20.0,
               bounded: bool = False) -> DataFrame:
    """(x - p25) / (p75 - p25 + 1e-8), clipped; quartiles interpolate linearly.

    ``bounded`` says that every key is one signal window of a known length; the built-in
    percentile, which holds a key's values in one task, is then the cheaper way.
    """
    if bounded:
        both = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
        q = (df.groupBy(*keys).agg(both.alias("__q"))
             .select(*keys, F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi")))
    else:
        q = quantiles(df, keys, value, {"__lo": 0.25, "__hi": 0.75})
    z = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-8))
    return (df.join(q, keys)
            .withColumn(name, F.greatest(F.least(z, F.lit(limit)), F.lit(-limit)))
            .drop("__lo", "__hi"))


def mean_imputed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Missing or non-finite values become the column mean, or 0 where there is none."""
    d = df.withColumn(value, missing_to_null(value))
    means = d.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    return (d.join(means, keys)
            .withColumn(value, F.coalesce(F.col(value), F.col("__mean"), F.lit(0.0)))
            .drop("__mean"))


def adjacent_pairs(dim: DataFrame, family: str, rank: str, member: str,
                   min_sizes: int = 2) -> DataFrame:
    """Consecutive sizes of each family with at least ``min_sizes`` of them."""
    w = Window.partitionBy(family)
    return (dim.withColumn("__n", F.count(F.lit(1)).over(w))
            .withColumn("next", F.lead(member).over(w.orderBy(rank)))
            .filter((F.col("__n") >= min_sizes) & F.col("next").isNotNull()).drop("__n"))


def intramodal_partner(dim: DataFrame, family: str, rank: str, member: str) -> DataFrame:
    """The next larger size; the largest pairs with the one below it."""
    w = Window.partitionBy(family).orderBy(rank)
    return dim.withColumn("partner", F.coalesce(F.lead(member).over(w), F.lag(member).over(w)))
