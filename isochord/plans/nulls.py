"""Queries on permutation and truncating nulls, model families and neighbourhood tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochord.functions.labels import sig_stars
from isochord.functions.vectors import r6
from isochord.operators import calibrate as cal
from isochord.operators import permute, shift_curve, stats
from isochord.plans import bindings as B
from isochord.plans import sqltext as S
from isochord.plans.alignment import (ALPHA, MCAL, edges, layer_curve, model_calibration, rounded,
                                      rsql)
from isochord.plans.registry import query

K, DRAWS, BLOCK_LEN = B.K, 200, 30
NULL_COLS = ["obs", "tau", "s_cal", "p", "null_mean"]


def perm_sql(n_expr: str, salt: str = "", name: str = "pm") -> str:
    return (f"{name} AS (SELECT draw, old, row_number() OVER (PARTITION BY draw ORDER BY "
            f"md5('{salt}' || draw::VARCHAR || ':' || old::VARCHAR), old) - 1 AS new "
            f"FROM (SELECT unnest(range({DRAWS})) AS draw), "
            f"(SELECT unnest(range({n_expr})) AS old FROM nw))")


PERM_SCORES = (
    f"mv AS (SELECT b.subject, b.layer, h.draw, h.new AS i, t.new AS j FROM nn b "
    f"JOIN pm h ON b.i = h.old JOIN pm t ON t.draw = h.draw AND b.j = t.old "
    f"WHERE b.side = 'b' UNION ALL SELECT subject, layer, -1, i, j FROM nn WHERE side = 'b'), "
    f"hs AS (SELECT a.subject, a.layer AS la, m.layer AS lb, draw, count(*) AS c FROM nn a "
    f"JOIN mv m ON a.side = 'a' AND a.subject = m.subject AND a.i = m.i AND a.j = m.j "
    f"GROUP BY ALL), "
    f"gr AS (SELECT DISTINCT a.subject, d.draw FROM nn a, (SELECT DISTINCT draw FROM mv) d), "
    f"sc AS (SELECT gr.subject, gr.draw, coalesce(max(c), 0) / (max(n) * {K})::DOUBLE AS score "
    f"FROM gr LEFT JOIN hs ON gr.subject = hs.subject AND gr.draw = hs.draw, nw "
    f"GROUP BY ALL), "
    f"ob AS (SELECT subject, score AS o FROM sc WHERE draw = -1), "
    f"lc AS (SELECT subject, max(o) AS obs, quantile_cont(score, 0.95) FILTER (draw >= 0) "
    f"AS tau, avg(score) FILTER (draw >= 0) AS null_mean, "
    f"(1 + count(*) FILTER (draw >= 0 AND score >= o)) / ({DRAWS} + 1)::DOUBLE AS p "
    f"FROM sc JOIN ob USING (subject) GROUP BY subject), "
    f"lin AS (SELECT *, CASE WHEN tau < 1 THEN greatest(obs - tau, 0.0) / (1 - tau) "
    f"ELSE 0.0 END AS s_cal FROM lc)")


def permuted(spark, sf, slots, perms):
    n = B.window_count(spark, sf)
    scores = permute.permuted_scores(
        edges(spark, sf, "a", slots), edges(spark, sf, "b", slots), ["la"], ["lb"],
        ["grid", "subject"], perms, DRAWS, n, K, B.slot_pairs(spark, slots, with_subject=True))
    best = scores.groupBy("subject", "draw").agg(F.max("score").alias("score"))
    return cal.calibrate_linear(best, ["subject"], F.col("draw") < 0, F.col("draw") >= 0, ALPHA)


@query("permutation_null_layers", f"WITH {S.spaces(S.LAYERED)}, {S.knn()}, {perm_sql('n')}, "
       f"{PERM_SCORES} SELECT {rsql(NULL_COLS)} FROM lin")
def permutation_null_layers(spark, sf):
    """Window permutation null, layer pair chosen anew in every draw."""
    perms = permute.permutation_table(spark, B.window_count(spark, sf), DRAWS)
    return rounded(permuted(spark, sf, B.LAYERED, perms), [], NULL_COLS)


@query("permutation_null_subjects", f"WITH {S.spaces(S.SUBJECTS)}, {S.knn()}, {perm_sql('n')}, "
       f"{PERM_SCORES} SELECT subject, {rsql(NULL_COLS)} FROM lin")
def permutation_null_subjects(spark, sf):
    perms = permute.permutation_table(spark, B.window_count(spark, sf), DRAWS)
    return rounded(permuted(spark, sf, B.SUBJECTS, perms), ["subject"], NULL_COLS)


NB = f"((n + {BLOCK_LEN - 1}) // {BLOCK_LEN})"


@query("block_perm_null", f"WITH {S.spaces(S.LAYERED)}, {S.knn()}, "
       f"{perm_sql(NB, 'b', 'bo')}, sz AS (SELECT draw, old AS block, new AS place, "
       f"least({BLOCK_LEN}, n - old * {BLOCK_LEN}) AS size FROM bo, nw), "
       f"st AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY draw ORDER BY place "
       f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sz), "
       f"pm AS (SELECT draw, block * {BLOCK_LEN} + o AS old, start + o AS new "
       f"FROM st, (SELECT unnest(range({BLOCK_LEN})) AS o) WHERE o < size), "
       f"{PERM_SCORES} SELECT {rsql(NULL_COLS)} FROM lin")
def block_perm_null(spark, sf):
    """Whole blocks change places, so that short-range smoothness stays in the null."""
    perms = permute.block_permutation_table(spark, B.window_count(spark, sf), BLOCK_LEN, DRAWS)
    return rounded(permuted(spark, sf, B.LAYERED, perms), [], NULL_COLS)


TRUNC = list(range(-50, 51))
TRUNC_SQL = (
    f"WITH {S.spaces(S.LAYERED)}, sh AS (SELECT unnest({TRUNC}) AS s), "
    f"cut AS (SELECT side, layer, s, w - greatest(CASE WHEN side = 'a' THEN s ELSE -s END, 0) "
    f"AS w, v FROM sp, sh, nw WHERE w >= greatest(CASE WHEN side = 'a' THEN s ELSE -s END, 0) "
    f"AND w < n - greatest(CASE WHEN side = 'a' THEN -s ELSE s END, 0)), "
    f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, layer, s, i "
    f"ORDER BY sim DESC, j) AS rank FROM (SELECT x.side, x.layer, x.s, x.w AS i, y.w AS j, "
    f"round(list_cosine_similarity(x.v, y.v), 12) AS sim FROM cut x JOIN cut y "
    f"ON x.side = y.side AND x.layer = y.layer AND x.s = y.s AND x.w <> y.w)) "
    f"WHERE rank <= {K}), hs AS (SELECT a.s, a.layer AS la, b.layer AS lb, count(*) AS c "
    f"FROM nn a JOIN nn b ON a.side = 'a' AND b.side = 'b' AND a.s = b.s AND a.i = b.i "
    f"AND a.j = b.j GROUP BY ALL), tr AS (SELECT sh.s::BIGINT AS shift, "
    f"coalesce(max(c), 0) / ((max(n) - abs(sh.s)) * {K})::DOUBLE AS score "
    f"FROM sh LEFT JOIN hs ON sh.s = hs.s, nw GROUP BY sh.s) ")


def truncated_curve(spark, sf):
    a = B.side(spark, sf, "a", B.LAYERED, "la")
    b = B.side(spark, sf, "b", B.LAYERED, "lb")
    return shift_curve.truncating_scores(a, b, ["la"], ["lb"], ["grid"],
                                         B.window_count(spark, sf), K, TRUNC)


@query("truncating_shift", TRUNC_SQL + f"SELECT shift, {S.r6('score')} AS score FROM tr")
def truncating_shift(spark, sf):
    """Both sides cut to the overlap and searched anew at every shift."""
    return truncated_curve(spark, sf).select(F.col("shift").cast("bigint").alias("shift"),
                                             r6("score").alias("score"))


@query("truncating_shift_p", TRUNC_SQL + f"SELECT {S.r6('max(o)')} AS obs, "
       f"{S.r6('(1 + count(*) FILTER (score >= o)) / (count(*) + 1)')} AS p FROM tr, "
       f"(SELECT score AS o FROM tr WHERE shift = 0)")
def truncating_shift_p(spark, sf):
    """Unshifted score among all shifts, itself included."""
    return rounded(cal.grid_p(truncated_curve(spark, sf), ["grid"], F.col("shift") == 0), [],
                   ["obs", "p"])


@query("subject_cells", f"WITH {S.spaces(S.SUBJECTS)}, {S.knn()}, {S.curve()}, "
       f"{S.cyclic('cv', 'subject')} SELECT {S.r6('avg(excess)')} AS excess, "
       f"{S.r6('avg(s_cal)')} AS s_cal, count(*) FILTER (p <= {ALPHA})::BIGINT AS n_sig, "
       f"count(*)::BIGINT AS n_cells FROM cal")
def subject_cells(spark, sf):
    """Mean over subjects of each subject's own calibration, and how many clear alpha."""
    c = cal.calibrate_cyclic(layer_curve(spark, sf, B.SUBJECTS), ["subject"],
                             B.window_count(spark, sf), ALPHA)
    return c.agg(r6(F.avg("excess")).alias("excess"), r6(F.avg("s_cal")).alias("s_cal"),
                 F.count_if(F.col("p") <= ALPHA).alias("n_sig"),
                 F.count(F.lit(1)).alias("n_cells"))


# -- families of models --------------------------------------------------------------

ALPHA_SQL = str(ALPHA)
BOTH = ("bo AS (SELECT a AS model, fa AS family, b AS other, fb AS other_family, ra, rb, obs, "
        "excess, s_cal, p FROM cal UNION ALL SELECT b, fb, a, fa, rb, ra, obs, excess, s_cal, p "
        "FROM cal)")


def both_ways(spark, sf):
    """Calibrated pairs seen from either model."""
    c = model_calibration(spark, sf)
    rest = ["obs", "excess", "s_cal", "p"]
    views = F.explode(F.array(*[
        F.struct(F.col(f"model_{x}").alias("model"), F.col(f"family_{x}").alias("family"),
                 F.col(f"model_{y}").alias("other"), F.col(f"family_{y}").alias("other_family"))
        for x, y in (("a", "b"), ("b", "a"))]))
    return c.select(*rest, views.alias("v")).select("v.*", *rest)


@query("cross_family_mean", f"{MCAL}, {BOTH} SELECT model, family, "
       f"{S.r6('avg(excess)')} AS excess, {S.r6('avg(s_cal)')} AS s_cal, "
       f"count(*) FILTER (p <= {ALPHA})::BIGINT AS n_sig, count(*)::BIGINT AS n_cells "
       f"FROM bo WHERE family <> other_family GROUP BY 1, 2")
def cross_family_mean(spark, sf):
    """Mean over partners of other families; siblings and the model itself are left out."""
    return (both_ways(spark, sf).filter("family != other_family").groupBy("model", "family")
            .agg(r6(F.avg("excess")).alias("excess"), r6(F.avg("s_cal")).alias("s_cal"),
                 F.count_if(F.col("p") <= ALPHA).alias("n_sig"),
                 F.count(F.lit(1)).alias("n_cells")))


@query("partner_family_mean", f"{MCAL}, {BOTH} SELECT model, other_family, "
       f"{S.r6('avg(excess)')} AS excess, count(*) FILTER (p <= {ALPHA})::BIGINT AS n_sig, "
       f"count(*)::BIGINT AS n_cells FROM bo WHERE family <> other_family GROUP BY 1, 2")
def partner_family_mean(spark, sf):
    """Mean over the sizes of one partner family."""
    return (both_ways(spark, sf).filter("family != other_family").groupBy("model", "other_family")
            .agg(r6(F.avg("excess")).alias("excess"),
                 F.count_if(F.col("p") <= ALPHA).alias("n_sig"),
                 F.count(F.lit(1)).alias("n_cells")))


@query("adjacent_sizes", f"{MCAL}, big AS (SELECT family FROM dim GROUP BY 1 "
       f"HAVING count(*) >= 3) SELECT a AS model, b AS next, {S.r6('excess')} AS excess, "
       f"{S.r6('null_mean')} AS null_mean FROM cal JOIN big ON fa = family "
       f"WHERE fa = fb AND abs(ra - rb) = 1")
def adjacent_sizes(spark, sf):
    """Excess and null mean of consecutive sizes, in families with three or more."""
    pairs = stats.adjacent_pairs(B.model_dim(spark), "family", "size_rank", "model", 3)
    c = model_calibration(spark, sf)
    return (c.join(F.broadcast(pairs.select(
                F.least("model", "next").alias("model_a"),
                F.greatest("model", "next").alias("model_b"), "model", "next")),
                ["model_a", "model_b"])
            .select("model", "next", r6("excess").alias("excess"),
                    r6("null_mean").alias("null_mean")))


@query("intramodal_partner", f"{MCAL}, {BOTH}, mx AS (SELECT family, max(size_rank) AS m "
       f"FROM dim GROUP BY 1) SELECT model, other AS partner, {S.r6('obs')} AS mknn FROM bo "
       f"JOIN mx ON mx.family = bo.family WHERE bo.family = other_family "
       f"AND rb = CASE WHEN ra < m THEN ra + 1 ELSE ra - 1 END")
def intramodal_partner(spark, sf):
    """Overlap with the next larger size; the largest pairs with the one below."""
    partner = stats.intramodal_partner(B.model_dim(spark), "family", "size_rank", "model")
    return (both_ways(spark, sf)
            .join(F.broadcast(partner.select("model", F.col("partner").alias("other"))),
                  ["model", "other"])
            .select("model", F.col("other").alias("partner"), r6("obs").alias("mknn")))


@query("centre_within_family", f"{MCAL}, {BOTH}, y AS (SELECT model, family, avg(excess) AS y "
       f"FROM bo WHERE family <> other_family GROUP BY 1, 2) SELECT model, family, "
       f"{S.r6('y - avg(y) OVER (PARTITION BY family)')} AS centred FROM y")
def centre_within_family(spark, sf):
    y = (both_ways(spark, sf).filter("family != other_family").groupBy("model", "family")
         .agg(F.avg("excess").alias("y")))
    return (stats.centred(y, ["family"], "y", "c")
            .select("model", "family", r6("c").alias("centred")))


@query("significance_stars", f"{MCAL} SELECT a AS model_a, b AS model_b, CASE WHEN p < 0.001 "
       f"THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars "
       f"FROM cal")
def significance_stars(spark, sf):
    return model_calibration(spark, sf).select("model_a", "model_b",
                                               sig_stars(F.col("p")).alias("stars"))


# -- neighbourhood tests --------------------------------------------------------------

P31 = 2147483647


def draw_sql(r: str, m: str, name: str, src: str, cols: str) -> str:
    """``name``: src with column idx = the hash index of (r, m)."""
    return (f"{name}1 AS (SELECT {cols}, ({r} * 48271 + {m} * 69621 + 1) % {P31} AS ha FROM {src}), "
            f"{name}2 AS (SELECT *, (ha * 16807) % {P31} AS hb FROM {name}1), "
            f"{name}3 AS (SELECT *, (hb * hb + ha) % {P31} AS hc FROM {name}2), "
            f"{name} AS (SELECT *, ((hc * hc + hb) % {P31}) % n AS idx FROM {name}3, nw)")


R_ENRICH, R_VAR, R_TRACE = 1000, 200, 200
FEATS = ("ft AS (SELECT w, unnest(['e1', 'e2', 'label']) AS feature, "
         "unnest([v[1], v[2], label::DOUBLE]) AS x FROM e)")


FEATURES = [*(f"e{i}" for i in range(1, 65)), "label"]
ALL_FEATS = (f"ft AS (SELECT w, unnest({FEATURES}) AS feature, "
             "unnest(list_concat(v::DOUBLE[], [label::DOUBLE])) AS x FROM e)")


def window_feature_table(spark, sf):
    """Every element of the vectors and the label, one column each."""
    return B.embeddings(spark, sf).select(
        "w", *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(64)],
        F.col("label").cast("double").alias("label"))


@query("neighbour_enrichment", f"WITH {S.spaces()}, {S.knn()}, {ALL_FEATS}, "
       f"ed AS (SELECT i, j FROM nn WHERE side = 'b'), tot AS (SELECT count(*) AS c FROM ed), "
       f"pl AS (SELECT unnest(range({R_ENRICH})) AS draw, c FROM tot), "
       f"pp AS (SELECT draw, unnest(range(c)) AS m FROM pl), "
       f"{draw_sql('draw', 'm', 'dr', 'pp', 'draw')}, "
       f"po AS (SELECT feature, avg(x) AS pm, stddev_pop(x) AS psd, var_pop(x) AS pv FROM ft "
       f"GROUP BY 1), ne AS (SELECT feature, count(*)::BIGINT AS c, round(avg(x), 9) AS om, "
       f"round(var_pop(x), 9) AS ov FROM ed JOIN ft ON ed.j = ft.w GROUP BY 1), "
       f"dn AS (SELECT draw, idx, count(*) AS c FROM dr GROUP BY 1, 2), "
       f"nu AS (SELECT ft.feature, draw, round(sum(c * (x - pm)) / sum(c) + any_value(pm), 9) AS nm, "
       f"round(sum(c * (x - pm) * (x - pm)) / sum(c) - (sum(c * (x - pm)) / sum(c)) ** 2, 9) AS nv "
       f"FROM dn JOIN ft ON idx = ft.w JOIN po ON po.feature = ft.feature GROUP BY 1, 2), pq AS (SELECT feature, "
       f"least(1.0, 2 * least(avg((nm >= om)::INT), avg((nm <= om)::INT))) AS p_mean, "
       f"least(1.0, 2 * least(avg((nv >= ov)::INT), avg((nv <= ov)::INT))) AS p_var "
       f"FROM nu JOIN ne USING (feature) GROUP BY 1), "
       f"bo AS (SELECT feature, x, true AS a FROM ed JOIN ft ON ed.j = ft.w UNION ALL "
       f"SELECT feature, x, false FROM ft), "
       f"rk AS (SELECT feature, a, x, rank() OVER (PARTITION BY feature ORDER BY x) + "
       f"(count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r, "
       f"sum(a::INT) OVER w / sum(a::INT) OVER (PARTITION BY feature) AS fa, "
       f"sum((NOT a)::INT) OVER w / sum((NOT a)::INT) OVER (PARTITION BY feature) AS fb FROM bo "
       f"WINDOW w AS (PARTITION BY feature ORDER BY x RANGE UNBOUNDED PRECEDING)), "
       f"ct AS (SELECT feature, (avg(x) FILTER (a) - avg(x) FILTER (NOT a)) / (sqrt(((count(*) "
       f"FILTER (a) - 1) * var_samp(x) FILTER (a) + (count(*) FILTER (NOT a) - 1) * var_samp(x) "
       f"FILTER (NOT a)) / (count(*) - 2)) + 1e-12) AS cd, (sum(r) FILTER (a) - count(*) FILTER (a) "
       f"* (count(*) FILTER (a) + 1) / 2.0) / (count(*) FILTER (a)::DOUBLE * count(*) FILTER "
       f"(NOT a)) AS auc, max(abs(fa - fb)) AS ks FROM rk GROUP BY 1) "
       f"SELECT feature, c AS n_neighbours, "
       f"{S.r6('(om - pm) / (psd + 1e-12)')} AS mean_shift_sigma, "
       f"{S.r6('ov / (pv + 1e-12)')} AS var_ratio, {S.r6('cd')} AS cohens_d, {S.r6('auc')} AS auc, "
       f"{S.r6('ks')} AS ks, {S.r6('p_mean')} AS p_mean, {S.r6('p_var')} AS p_var FROM ne "
       f"JOIN po USING (feature) JOIN pq USING (feature) JOIN ct USING (feature)")
def neighbour_enrichment(spark, sf):
    out = permute.neighbour_enrichment(
        edges(spark, sf, "b").select("i", "j"), window_feature_table(spark, sf),
        FEATURES, B.window_count(spark, sf), R_ENRICH)
    return rounded(out, ["feature", "n_neighbours"],
                   ["mean_shift_sigma", "var_ratio", "cohens_d", "auc", "ks", "p_mean", "p_var"])


@query("varratio_test", f"WITH {S.spaces()}, {S.knn()}, {FEATS}, "
       f"ed AS (SELECT i, j FROM nn WHERE side = 'b'), "
       f"us AS (SELECT i, count(*) AS c FROM ed GROUP BY 1 HAVING count(*) >= 2), "
       f"gv AS (SELECT feature, var_samp(x) + 1e-12 AS g FROM ft GROUP BY 1), "
       f"ob AS (SELECT feature, round(median(r), 9) AS med, count(*)::BIGINT AS n_used FROM (SELECT "
       f"ft.feature, ed.i, var_samp(x) / max(g) AS r FROM ed JOIN us USING (i) JOIN ft "
       f"ON ed.j = ft.w JOIN gv USING (feature) GROUP BY 1, 2) GROUP BY 1), "
       f"pl AS (SELECT i, c, unnest(range({R_VAR})) AS draw FROM us), "
       f"pp AS (SELECT i, draw, i * 1000003 + unnest(range(c)) AS m FROM pl), "
       f"{draw_sql('draw', 'm', 'dr', 'pp', 'i, draw')}, "
       f"nu AS (SELECT feature, draw, round(median(r), 9) AS nmed FROM (SELECT ft.feature, draw, i, "
       f"var_samp(x) / max(g) AS r FROM dr JOIN ft ON idx = ft.w JOIN gv USING (feature) "
       f"GROUP BY 1, 2, 3) GROUP BY 1, 2), ps AS (SELECT feature, n_used, max(med) AS med, "
       f"(1 + count(*) FILTER (nmed <= med)) / ({R_VAR} + 1) AS p "
       f"FROM nu JOIN ob USING (feature) GROUP BY 1, 2), "
       f"sc AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature DESC) AS s "
       f"FROM ps) SELECT feature, n_used, {S.r6('med')} AS median_ratio, {S.r6('p')} AS p, "
       f"{S.r6('least(1.0, min(s) OVER (ORDER BY p DESC, feature ROWS UNBOUNDED PRECEDING))')} AS q "
       f"FROM sc")
def varratio_test(spark, sf):
    out = permute.varratio(edges(spark, sf, "b").select("i", "j"),
                           window_feature_table(spark, sf), ["e1", "e2", "label"],
                           B.window_count(spark, sf), R_VAR)
    return rounded(out, ["feature", "n_used"], ["median_ratio", "p", "q"])


@query("trace_cov_ratio_test", f"WITH {S.spaces()}, {S.knn()}, "
       f"ed AS (SELECT i, j FROM nn WHERE side = 'b'), "
       f"us AS (SELECT i, count(*) AS c FROM ed GROUP BY 1 HAVING count(*) >= 2), "
       f"xe AS (SELECT w, unnest(range(1, len(v) + 1)) AS f, unnest(v) AS x FROM sp "
       f"WHERE side = 'a'), "
       f"gt AS (SELECT sum(v) + 1e-12 AS g FROM (SELECT var_samp(x) AS v FROM xe GROUP BY f)), "
       f"ob AS (SELECT round(median(t / g), 9) AS med, count(*)::BIGINT AS n_used FROM (SELECT i, sum(v) "
       f"AS t FROM (SELECT i, f, var_samp(x) AS v FROM ed JOIN us USING (i) JOIN xe "
       f"ON ed.j = xe.w GROUP BY 1, 2) GROUP BY 1), gt), "
       f"pl AS (SELECT i, c, unnest(range({R_TRACE})) AS draw FROM us), "
       f"pp AS (SELECT i, draw, i * 1000003 + unnest(range(c)) AS m FROM pl), "
       f"{draw_sql('draw', 'm', 'dr', 'pp', 'i, draw')}, "
       f"nu AS (SELECT draw, round(median(t / g), 9) AS nmed FROM (SELECT draw, i, sum(v) AS t FROM "
       f"(SELECT draw, i, f, var_samp(x) AS v FROM dr JOIN xe ON idx = xe.w GROUP BY 1, 2, 3) "
       f"GROUP BY 1, 2), gt GROUP BY 1) SELECT {S.r6('max(med)')} AS median_ratio, n_used, "
       f"{S.r6(f'(1 + count(*) FILTER (nmed <= med)) / ({R_TRACE} + 1)')} AS p "
       f"FROM nu, ob GROUP BY n_used")
def trace_cov_ratio_test(spark, sf):
    """Spread of one space's vectors among the other space's neighbours."""
    out = permute.trace_cov_ratio(edges(spark, sf, "b").select("i", "j"),
                                  B.side(spark, sf, "a"), B.window_count(spark, sf), R_TRACE)
    return rounded(out, ["n_used"], ["median_ratio", "p"])
