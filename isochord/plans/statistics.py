"""Queries on effect sizes, concentration, rank and regression statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochord.functions.vectors import r6
from isochord.operators import overlap, stats
from isochord.plans import bindings as B
from isochord.plans import sqltext as S
from isochord.plans.alignment import rounded, rsql
from isochord.plans.registry import query


def lineitem(spark, sf, *cols):
    return B.table(spark, sf, "lineitem").select(*cols)


def orders(spark, sf, *cols):
    return B.table(spark, sf, "orders").select(*cols)


def avg_rank(col: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col}) + "
            f"(count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0)")


def t_tail(t: str, df: str) -> str:
    """Two-sided Student-t tail by sums at midpoints, from |t| and from 0 (for df over 50)."""
    def area(start):
        return (f"(SELECT sum(exp(-({df} + 1) / 2 * ln(1 + u * u / {df}))) FROM "
                f"(SELECT {start} + (unnest(range(80000)) + 0.5) * 0.0005 AS u))")
    return f"({area(f'abs({t})')} / {area('0')})"


@query("spearman", f"WITH c AS (SELECT l_returnflag, count(*)::BIGINT AS n, corr(a, b) AS rho "
       f"FROM (SELECT l_returnflag, {avg_rank('l_quantity', 'l_returnflag')} AS a, "
       f"{avg_rank('l_extendedprice', 'l_returnflag')} AS b FROM lineitem) GROUP BY 1), "
       f"t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0 AS df FROM c) "
       f"SELECT l_returnflag, n, {S.r6('rho')} AS rho, {S.r6(t_tail('t', 'df'))} AS p FROM t")
def spearman(spark, sf):
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_extendedprice")
    return (stats.spearman(df, ["l_returnflag"], "l_quantity", "l_extendedprice")
            .select("l_returnflag", "n", r6("rho").alias("rho"), r6("p").alias("p")))


@query("spearman_weak", f"WITH c AS (SELECT o_orderpriority, count(*)::BIGINT AS n, "
       f"corr(a, b) AS rho FROM (SELECT o_orderpriority, "
       f"{avg_rank('o_totalprice', 'o_orderpriority')} AS a, "
       f"{avg_rank('o_custkey', 'o_orderpriority')} AS b FROM orders) GROUP BY 1), "
       f"t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0 AS df FROM c) "
       f"SELECT o_orderpriority, n, {S.r6('rho')} AS rho, {S.r6(t_tail('t', 'df'))} AS p FROM t")
def spearman_weak(spark, sf):
    """As above for columns with little in common, where p is not 0."""
    df = orders(spark, sf, "o_orderpriority", "o_totalprice", "o_custkey")
    return rounded(stats.spearman(df, ["o_orderpriority"], "o_totalprice", "o_custkey"),
                   ["o_orderpriority", "n"], ["rho", "p"])



@query("family_rank", "SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand "
       "ORDER BY p_retailprice, p_partkey) - 1)::INT AS size_rank FROM part")
def family_rank(spark, sf):
    """Members of a family numbered by size, as models of one family are."""
    df = B.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return overlap.ranked_once(df, ["p_brand"], F.struct("p_retailprice", "p_partkey"),
                               "size_rank").select("p_partkey", "p_brand", "size_rank")


@query("cohens_d", f"SELECT o_orderpriority, {S.r6('(avg(x) FILTER (a) - avg(x) FILTER (NOT a)) / (sqrt(((count(*) FILTER (a) - 1) * var_samp(x) FILTER (a) + (count(*) FILTER (NOT a) - 1) * var_samp(x) FILTER (NOT a)) / (count(*) - 2)) + 1e-12)')} "
       f"AS cohens_d FROM (SELECT o_orderpriority, o_totalprice AS x, o_orderstatus = 'F' AS a "
       f"FROM orders) GROUP BY 1")
def cohens_d(spark, sf):
    df = orders(spark, sf, "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(stats.cohens_d(df, ["o_orderpriority"], "o_totalprice",
                                  F.col("o_orderstatus") == "F"),
                   ["o_orderpriority"], ["cohens_d"])


@query("cles_auc", f"SELECT o_orderpriority, {S.r6('(sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0) / (count(*) FILTER (a)::DOUBLE * count(*) FILTER (NOT a))')} "
       f"AS auc FROM (SELECT o_orderpriority, o_orderstatus = 'F' AS a, "
       f"{avg_rank('o_totalprice', 'o_orderpriority')} AS r FROM orders) GROUP BY 1")
def cles_auc(spark, sf):
    df = orders(spark, sf, "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(stats.cles_auc(df, ["o_orderpriority"], "o_totalprice",
                                  F.col("o_orderstatus") == "F"), ["o_orderpriority"], ["auc"])


@query("ks_stat", f"SELECT o_orderpriority, {S.r6('max(abs(ca / na - cb / nb))')} AS ks FROM "
       f"(SELECT o_orderpriority, sum(a) OVER w AS ca, sum(1 - a) OVER w AS cb, "
       f"sum(a) OVER (PARTITION BY o_orderpriority)::DOUBLE AS na, "
       f"sum(1 - a) OVER (PARTITION BY o_orderpriority)::DOUBLE AS nb FROM (SELECT *, "
       f"(o_orderstatus = 'F')::INT AS a FROM orders) "
       f"WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING)) "
       f"GROUP BY 1")
def ks_stat(spark, sf):
    df = orders(spark, sf, "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(stats.ks_stat(df, ["o_orderpriority"], "o_totalprice",
                                 F.col("o_orderstatus") == "F"), ["o_orderpriority"], ["ks"])


@query("gini", f"WITH s AS (SELECT c_mktsegment AS g, c_acctbal - least(min(c_acctbal) OVER "
       f"(PARTITION BY c_mktsegment), 0) AS x FROM customer), "
       f"c AS (SELECT g, sum(x) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) AS cum, "
       f"sum(x) OVER (PARTITION BY g) AS tot, count(*) OVER (PARTITION BY g) AS n FROM s) "
       f"SELECT g AS c_mktsegment, {S.r6('(max(n) + 1 - 2 * sum(cum / tot)) / max(n)')} AS gini "
       f"FROM c GROUP BY 1")
def gini(spark, sf):
    df = B.table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    return rounded(stats.gini(df, ["c_mktsegment"], "c_acctbal"), ["c_mktsegment"], ["gini"])


@query("gini_overall", f"WITH c AS (SELECT sum(x) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) "
       f"AS cum, sum(x) OVER () AS tot, count(*) OVER () AS n FROM (SELECT value AS x FROM "
       f"events)) SELECT {S.r6('(max(n) + 1 - 2 * sum(cum / tot)) / max(n)')} AS gini FROM c")
def gini_overall(spark, sf):
    df = B.table(spark, sf, "events").select("value")
    return rounded(stats.gini(df, [], "value"), [], ["gini"])


@query("lorenz", f"SELECT DISTINCT c_acctbal AS value, {S.r6('cn / n')} AS frac, "
       f"{S.r6('cum / tot')} AS share FROM (SELECT greatest(c_acctbal, 0.0) AS c_acctbal, "
       f"count(*) OVER w AS cn, count(*) OVER ()::DOUBLE AS n, "
       f"sum(greatest(c_acctbal, 0.0)) OVER w AS cum, "
       f"sum(greatest(c_acctbal, 0.0)) OVER () AS tot FROM customer "
       f"WINDOW w AS (ORDER BY greatest(c_acctbal, 0.0) DESC RANGE UNBOUNDED PRECEDING))")
def lorenz(spark, sf):
    df = B.table(spark, sf, "customer").select("c_acctbal")
    return (stats.lorenz(df, [], "c_acctbal")
            .select(F.col("c_acctbal").alias("value"), r6("frac").alias("frac"),
                    r6("share").alias("share")))


P_EXPR = ("CASE WHEN c_mktsegment <> 'BUILDING' THEN "
          "least(greatest((c_acctbal + 1000) / 11000, 0.0), 1.0) END")


@query("benjamini_hochberg", f"WITH p AS (SELECT c_custkey, {P_EXPR} AS p FROM customer), "
       f"r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED "
       f"PRECEDING) AS ratio FROM p WHERE p IS NOT NULL), "
       f"q AS (SELECT c_custkey, least(1.0, min(ratio) OVER (ORDER BY p DESC RANGE UNBOUNDED "
       f"PRECEDING)) AS q FROM r) SELECT c_custkey, {S.r6('p.p')} AS p, {S.r6('q')} AS q "
       f"FROM p LEFT JOIN q USING (c_custkey)")
def benjamini_hochberg(spark, sf):
    df = B.table(spark, sf, "customer").select("c_custkey", F.expr(P_EXPR).alias("p"))
    return rounded(stats.benjamini_hochberg(df, "p"), ["c_custkey"], ["p", "q"])


@query("ols_slope", f"SELECT l_returnflag, {S.r6('regr_slope(l_extendedprice, l_quantity)')} "
       f"AS slope FROM lineitem GROUP BY 1")
def ols_slope(spark, sf):
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(stats.ols_slope(df, ["l_returnflag"], "l_quantity", "l_extendedprice"),
                   ["l_returnflag"], ["slope"])


@query("r2_ols", f"SELECT l_returnflag, {S.r6('regr_r2(l_extendedprice, l_quantity)')} AS r2 "
       f"FROM lineitem GROUP BY 1")
def r2_ols(spark, sf):
    return (lineitem(spark, sf, "l_returnflag", "l_quantity", "l_extendedprice")
            .groupBy("l_returnflag")
            .agg(r6(stats.r2_from_corr("l_extendedprice", "l_quantity")).alias("r2")))


VP = ["r2_1", "r2_2", "r2_full", "unique_1", "unique_2"]


@query("variance_partition_2", "WITH c AS (SELECT l_returnflag, corr(l_extendedprice, l_quantity) "
       "AS y1, corr(l_extendedprice, l_discount) AS y2, corr(l_quantity, l_discount) AS x12 "
       "FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, y1 * y1 AS r2_1, y2 * y2 AS r2_2, "
       "(y1 * y1 + y2 * y2 - 2 * y1 * y2 * x12) / (1 - x12 * x12) AS r2_full FROM c), "
       "e AS (SELECT *, r2_full - r2_2 AS unique_1, r2_full - r2_1 AS unique_2 FROM d) "
       f"SELECT l_returnflag, {rsql(VP)} FROM e")
def variance_partition_2(spark, sf):
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    return rounded(stats.variance_partition_2(df, ["l_returnflag"], "l_extendedprice",
                                              "l_quantity", "l_discount"),
                   ["l_returnflag"], VP)


def orthogonal_sql(steps: list[tuple[str, str, list[str]]]) -> str:
    """Columns made orthogonal one after the other: (new, old, earlier new ones) per step.

    Slopes on orthogonal columns are slopes on each alone.
    """
    out, last = [], "li"
    for new, old, before in steps:
        slopes = ", ".join(f"regr_slope({old}, {z}) AS s_{z}" for z in before)
        less = "".join(f" - s_{z} * {z}" for z in before)
        join = (f"{last} JOIN (SELECT l_returnflag, {slopes} FROM {last} GROUP BY 1) "
                f"USING (l_returnflag)" if before else last)
        drop = f" EXCLUDE ({', '.join(f's_{z}' for z in before)})" if before else ""
        out.append(f"x_{new} AS (SELECT *{drop}, {old}{less} AS {new} FROM {join})")
        last = f"x_{new}"
    return ", ".join(out)


LI = ("li AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS q, l_discount AS d, "
      "l_tax AS t, l_linenumber::DOUBLE AS l FROM lineitem)")
VB = ["r2_full", "r2_a", "r2_b", "unique_a", "unique_b"]


@query("variance_partition", f"WITH {LI}, " + orthogonal_sql([
    ("z1", "q", []), ("z2", "d", ["z1"]), ("z3", "t", ["z1", "z2"]), ("z4", "l", ["z1", "z2", "z3"]),
    ("v1", "t", []), ("v2", "l", ["v1"])])
    + ", c AS (SELECT l_returnflag, count(*)::BIGINT AS n, corr(y, z1) ** 2 + corr(y, z2) ** 2 "
    "AS r2_a, corr(y, v1) ** 2 + corr(y, v2) ** 2 AS r2_b, corr(y, z1) ** 2 + corr(y, z2) ** 2 + "
    "corr(y, z3) ** 2 + corr(y, z4) ** 2 AS r2_full FROM x_v2 GROUP BY 1), "
    "p AS (SELECT *, r2_full - r2_b AS unique_a, r2_full - r2_a AS unique_b FROM c) "
    f"SELECT l_returnflag, n, {rsql(VB)} FROM p")
def variance_partition(spark, sf):
    """Two blocks of two predictors each."""
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linenumber",
                  "l_extendedprice")
    return rounded(stats.variance_partition(
        df, ["l_returnflag"], "l_extendedprice",
        {"a": ["l_quantity", "l_discount"], "b": ["l_tax", "l_linenumber"]}),
        ["l_returnflag", "n"], VB)


@query("partial_corr", f"WITH {LI}, " + orthogonal_sql([
    ("z1", "q", []), ("z2", "d", ["z1"]), ("z3", "l", ["z1", "z2"]),
    ("ry", "y", ["z1", "z2", "z3"]), ("rt", "t", ["z1", "z2", "z3"])])
    + f" SELECT l_returnflag, count(*)::BIGINT AS n, {S.r6('corr(ry, rt)')} AS partial_corr "
    "FROM x_rt GROUP BY 1")
def partial_corr(spark, sf):
    """Three controls."""
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linenumber",
                  "l_extendedprice")
    return rounded(stats.partial_corr(df, ["l_returnflag"], "l_extendedprice", "l_tax",
                                      ["l_quantity", "l_discount", "l_linenumber"]),
                   ["l_returnflag", "n"], ["partial_corr"])


@query("partial_corr_1", "WITH r AS (SELECT l_returnflag, l_extendedprice AS x, l_tax AS y, "
       "l_quantity AS z FROM lineitem), b AS (SELECT l_returnflag, regr_slope(x, z) AS sx, "
       "regr_intercept(x, z) AS ix, regr_slope(y, z) AS sy, regr_intercept(y, z) AS iy FROM r "
       f"GROUP BY 1) SELECT l_returnflag, {S.r6('corr(x - sx * z - ix, y - sy * z - iy)')} "
       "AS partial_corr FROM r JOIN b USING (l_returnflag) GROUP BY 1")
def partial_corr_1(spark, sf):
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_tax", "l_extendedprice")
    return rounded(stats.partial_corr_1(df, ["l_returnflag"], "l_extendedprice", "l_tax",
                                        "l_quantity"), ["l_returnflag"], ["partial_corr"])


@query("ancova_slope", "WITH r AS (SELECT l_returnflag AS f, l_quantity AS x, "
       "l_extendedprice AS y FROM lineitem), d AS (SELECT f, x, y, "
       "x - avg(x) OVER (PARTITION BY f) AS dx, y - avg(y) OVER (PARTITION BY f) AS dy FROM r), "
       "a AS (SELECT count(*)::BIGINT AS n, regr_slope(y, x) AS slope_unadj, "
       "sum(dx * dy) / sum(dx * dx) AS slope_adj, "
       "sum(dx * dy) ** 2 / sum(dx * dx) / (sum(dy * dy) + 1e-12) AS partial_eta2, "
       "count(*) - count(DISTINCT f) - 1.0 AS df, sum(dx * dx) AS sxx, "
       "sum(dy * dy) - sum(dx * dy) ** 2 / sum(dx * dx) AS sse FROM d), "
       "t AS (SELECT *, slope_adj / sqrt(sse / df / sxx) AS t FROM a) "
       f"SELECT n, {rsql(['slope_unadj', 'slope_adj', 'partial_eta2', 't'])}, "
       f"{S.r6(t_tail('t', 'df'))} AS p FROM t")
def ancova_slope(spark, sf):
    df = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(stats.ancova(df, "l_returnflag", "l_quantity", "l_extendedprice"), ["n"],
                   ["slope_unadj", "slope_adj", "partial_eta2", "t", "p"])


@query("paired_sem", "WITH c AS (SELECT c_mktsegment AS subject, o_orderstatus AS model, "
       "avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), "
       "d AS (SELECT *, y - avg(y) OVER (PARTITION BY subject) AS r FROM c) "
       f"SELECT model, {S.r6('avg(y)')} AS mean, "
       f"{S.r6('stddev_samp(y) / sqrt(count(*))')} AS sem, "
       f"{S.r6('stddev_samp(r) / sqrt(count(*))')} AS sem_paired FROM d GROUP BY 1")
def paired_sem(spark, sf):
    cells = (orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice")
             .join(B.table(spark, sf, "customer").select(
                 F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
             .groupBy(F.col("c_mktsegment").alias("subject"), F.col("o_orderstatus").alias("model"))
             .agg(F.avg("o_totalprice").alias("y")))
    return rounded(stats.paired_sem(cells, "subject", "model", "y"), ["model"],
                   ["mean", "sem", "sem_paired"])


@query("window_zscore", f"SELECT l_orderkey, l_linenumber, {S.r6('(l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-8)')} "
       f"AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def window_zscore(spark, sf):
    df = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return rounded(stats.zscored(df, ["l_suppkey"], "l_quantity", "z"),
                   ["l_orderkey", "l_linenumber"], ["z"])


@query("session_zscore", f"WITH s AS (SELECT event_type, avg(value) AS m, "
       f"sqrt(greatest(avg(value * value) - avg(value) ** 2, 0)) AS sd FROM events GROUP BY 1) "
       f"SELECT event_id, {S.r6('greatest(least((value - m) / CASE WHEN sd < 1e-10 THEN 1.0 ELSE sd END, 3.0), -3.0)')} "
       f"AS z FROM events JOIN s USING (event_type)")
def session_zscore(spark, sf):
    """Standardised by whole-session moments, flat channels left as they are, clipped."""
    df = B.table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(stats.zscored(df, ["event_type"], "value", "z", flat=1e-10, limit=3.0),
                   ["event_id"], ["z"])


@query("iqr_normalise", f"WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, "
       f"quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, "
       f"{S.r6('greatest(least((value - a) / (b - a + 1e-8), 20.0), -20.0)')} AS z "
       f"FROM events JOIN q USING (user_id)")
def iqr_normalise(spark, sf):
    df = B.table(spark, sf, "events").select("event_id", "user_id", "value")
    return rounded(stats.iqr_scaled(df, ["user_id"], "value", "z"), ["event_id"], ["z"])


@query("impute_mean", f"WITH v AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' "
       f"THEN value END AS x FROM events) SELECT event_id, "
       f"{S.r6('coalesce(x, avg(x) OVER (PARTITION BY user_id), 0)')} AS x FROM v")
def impute_mean(spark, sf):
    df = B.table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("x"))
    return rounded(stats.mean_imputed(df, ["user_id"], "x"), ["event_id"], ["x"])
