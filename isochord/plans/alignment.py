"""Queries on neighbour graphs, overlap, rotations, calibration and CKA."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochord.functions.vectors import doubles, l2, modulo, r6, signed_shift
from isochord.operators import calibrate as cal
from isochord.operators import cka, knn, overlap, shift_curve
from isochord.operators.gram import gram_cka
from isochord.operators.knn_pivots import pruned_knn_edges
from isochord.plans import bindings as B
from isochord.plans import sqltext as S
from isochord.plans.registry import query
from isochord.session import written

K, ALPHA = B.K, B.ALPHA
ON = ["grid"]


# -- shared inputs -----------------------------------------------------------------

def edges(spark, sf, which, slots=B.PLAIN, excl=0, k=K):
    """Neighbour edges of one side, layer renamed to la / lb."""
    name = "la" if which == "a" else "lb"
    return knn.knn_edges(B.side(spark, sf, which, slots, name),
                         ["grid", "subject", name], k, excl,
                         n_windows=B.window_count(spark, sf))


def layer_curve(spark, sf, slots=B.PLAIN, excl=0):
    """Score per layer pair, subject and rotation."""
    return shift_curve.shift_curve(
        edges(spark, sf, "a", slots, excl), edges(spark, sf, "b", slots, excl),
        ["la"], ["lb"], ["grid", "subject"], B.window_count(spark, sf), K,
        pairs=B.slot_pairs(spark, slots, with_subject=True))


def model_curves(spark, sf):
    """Score per unordered model pair and rotation, with families and size ranks."""
    n = B.window_count(spark, sf)
    nn = knn.knn_edges(B.models(spark, sf), ["grid", "model"], K, n_windows=n)
    if n > shift_curve.SEGMENT:     # both sides are then written apart, each after its own search
        nn = written(nn.select("grid", "model", "i", "j"), "models")
    a = nn.withColumnRenamed("model", "model_a")
    b = nn.withColumnRenamed("model", "model_b")
    pairs = B.model_pairs(spark)
    counts = shift_curve.shift_curve(
        a, b, ["model_a"], ["model_b"], ON, n, K,
        pairs=pairs.select("grid", "model_a", "model_b"))
    return counts.join(F.broadcast(pairs), ["grid", "model_a", "model_b"])


# -- vectors and neighbours ---------------------------------------------------------

@query("l2_normalize", f"WITH {S.E} SELECT w, unnest(range(1, 65)) AS pos, "
       f"{S.r6('unnest(v) / (sqrt(list_dot_product(v, v)) + 1e-12)')} AS x FROM e")
def l2_normalize(spark, sf):
    return (B.embeddings(spark, sf)
            .select("w", F.posexplode(l2(doubles("embedding"))).alias("pos", "x"))
            .select("w", (F.col("pos") + 1).cast("bigint").alias("pos"), r6("x").alias("x")))


@query("knn_topk", f"WITH {S.spaces()}, {S.knn()} "
       f"SELECT side, i, j, rank::BIGINT AS rank, {S.r6('sim')} AS sim FROM nn")
def knn_topk(spark, sf):
    return (edges(spark, sf, "a").select(F.lit("a").alias("side"), "i", "j", "rank", "sim")
            .union(edges(spark, sf, "b").select(F.lit("b"), "i", "j", "rank", "sim"))
            .select("side", "i", "j", F.col("rank").cast("bigint").alias("rank"),
                    r6("sim").alias("sim")))


@query("knn_topk_pruned", f"WITH {S.spaces(S.WHOLE)}, {S.knn()} "
       f"SELECT i, j, rank::BIGINT AS rank, {S.r6('sim')} AS sim FROM nn WHERE side = 'a'")
def knn_topk_pruned(spark, sf):
    """Whole vectors, searched cell by cell: what a pivot's radius rules out is not compared."""
    out = pruned_knn_edges(B.side(spark, sf, "a", B.WHOLE), ["grid"], B.K, cell_rows=256)
    return out.select("i", "j", F.col("rank").cast("bigint").alias("rank"), r6("sim").alias("sim"))


@query("knn_topk_excl", f"WITH {S.spaces(S.WHOLE)}, {S.knn(excl=10)} "
       f"SELECT i, j, rank::BIGINT AS rank, {S.r6('sim')} AS sim FROM nn WHERE side = 'a'")
def knn_topk_excl(spark, sf):
    return edges(spark, sf, "a", B.WHOLE, excl=10).select(
        "i", "j", F.col("rank").cast("bigint").alias("rank"), r6("sim").alias("sim"))


@query("knn_per_subject", f"WITH {S.spaces(S.EIGHTHS)}, {S.knn()} "
       f"SELECT subject, i, j, rank::BIGINT AS rank FROM nn")
def knn_per_subject(spark, sf):
    return edges(spark, sf, "a", B.EIGHTHS).select(
        "subject", "i", "j", F.col("rank").cast("bigint").alias("rank"))


@query("offset_edges", f"WITH {S.spaces(S.WHOLE)}, {S.knn()} "
       f"SELECT ((i - j) % n + n) % n AS u, count(*)::BIGINT AS n_edges "
       f"FROM nn, nw WHERE side = 'a' GROUP BY 1")
def offset_edges(spark, sf):
    n = B.window_count(spark, sf)
    return (edges(spark, sf, "a", B.WHOLE)
            .groupBy(modulo(F.col("i") - F.col("j"), n).alias("u"))
            .agg(F.count(F.lit(1)).alias("n_edges")))


# -- overlap ------------------------------------------------------------------------

@query("mknn_scalar", f"WITH {S.spaces()}, {S.knn()} "
       f"SELECT {S.r6(f'count(*) / (max(n) * {K})::DOUBLE')} AS mknn FROM nn a "
       f"JOIN nn b ON a.i = b.i AND a.j = b.j AND a.side = 'a' AND b.side = 'b', nw")
def mknn_scalar(spark, sf):
    n = B.window_count(spark, sf)
    return (overlap.mknn(edges(spark, sf, "a"), edges(spark, sf, "b"), ["la"], ["lb"],
                         ["grid", "subject"], n, K,
                         pairs=B.slot_pairs(spark, B.PLAIN, with_subject=True))
            .select(r6("mknn").alias("mknn")))


LAYER_GRID = (f"WITH {S.spaces(S.LAYERED)}, {S.knn()}, g AS (SELECT a.layer AS la, "
              f"b.layer AS lb, count(*) / (max(n) * {K})::DOUBLE AS m FROM nn a JOIN nn b "
              f"ON a.i = b.i AND a.j = b.j AND a.side = 'a' AND b.side = 'b', nw GROUP BY 1, 2)")


def layer_grid(spark, sf):
    return overlap.mknn(edges(spark, sf, "a", B.LAYERED), edges(spark, sf, "b", B.LAYERED),
                        ["la"], ["lb"], ["grid", "subject"], B.window_count(spark, sf), K,
                        pairs=B.slot_pairs(spark, B.LAYERED, with_subject=True))


@query("mknn_layer_grid", f"{LAYER_GRID} SELECT la, lb, {S.r6('m')} AS mknn FROM g")
def mknn_layer_grid(spark, sf):
    return layer_grid(spark, sf).select("la", "lb", r6("mknn").alias("mknn"))


@query("best_layer_pair", f"{LAYER_GRID} SELECT la, lb, {S.r6('m')} AS mknn FROM g "
       f"ORDER BY m DESC, la, lb LIMIT 1")
def best_layer_pair(spark, sf):
    return (overlap.best_pair(layer_grid(spark, sf), [], ["la", "lb"])
            .select("la", "lb", r6("mknn").alias("mknn")))


@query("max_mknn_over_layers", f"{LAYER_GRID} SELECT {S.r6('max(m)')} AS mknn FROM g")
def max_mknn_over_layers(spark, sf):
    return layer_grid(spark, sf).agg(r6(F.max("mknn")).alias("mknn"))


@query("mknn_per_window", f"WITH {S.spaces()}, {S.knn()} "
       f"SELECT a.i AS w, {S.r6(f'count(b.i) / {K}.0')} AS share FROM nn a LEFT JOIN nn b "
       f"ON a.i = b.i AND a.j = b.j AND b.side = 'b' WHERE a.side = 'a' GROUP BY a.i")
def mknn_per_window(spark, sf):
    return (overlap.mknn_per_window(edges(spark, sf, "a"), edges(spark, sf, "b"), ON, K)
            .select("w", r6("share").alias("share")))


@query("relabel_shift", f"WITH {S.spaces(S.WHOLE)}, {S.knn()} SELECT (i + 97) % n AS i, "
       f"(j + 97) % n AS j FROM nn, nw")
def relabel_shift(spark, sf):
    return (overlap.relabel(edges(spark, sf, "a", B.WHOLE), 97, B.window_count(spark, sf))
            .select("i", "j"))


@query("shared_neighbour_counts", f"WITH {S.spaces()}, {S.knn()} SELECT n_shared, "
       f"count(*)::BIGINT AS n_windows FROM (SELECT a.i, count(*)::BIGINT AS n_shared "
       f"FROM nn a JOIN nn b ON a.i = b.i AND a.j = b.j AND a.side = 'a' AND b.side = 'b' "
       f"GROUP BY 1 HAVING count(*) >= 1) GROUP BY 1")
def shared_neighbour_counts(spark, sf):
    sets = overlap.shared_sets(edges(spark, sf, "a"), edges(spark, sf, "b"), ON)
    per = sets.groupBy("i").agg(F.count(F.lit(1)).alias("n_shared")).filter("n_shared >= 1")
    return per.groupBy("n_shared").agg(F.count(F.lit(1)).alias("n_windows"))


# -- rotations ----------------------------------------------------------------------

CURVE = f"WITH {S.spaces()}, {S.knn()}, {S.curve()}"
LCURVE = (f"WITH {S.spaces(S.LAYERED)}, {S.knn()}, {S.curve()}, "
          f"mx AS (SELECT d, max(score) AS score FROM cv GROUP BY d)")
SCURVE = f"WITH {S.spaces(S.SUBJECTS)}, {S.knn()}, {S.curve()}"
XCURVE = f"WITH {S.spaces()}, {S.knn(excl=10)}, {S.curve()}"


@query("mknn_all_shifts", f"{CURVE} SELECT d, {S.r6('score')} AS score FROM cv")
def mknn_all_shifts(spark, sf):
    return layer_curve(spark, sf).select("d", r6("score").alias("score"))


@query("mknn_all_shifts_excl", f"{XCURVE} SELECT d, {S.r6('score')} AS score FROM cv")
def mknn_all_shifts_excl(spark, sf):
    return layer_curve(spark, sf, excl=10).select("d", r6("score").alias("score"))


def layer_max_curve(spark, sf):
    return shift_curve.max_over_layers(layer_curve(spark, sf, B.LAYERED), ON)


@query("mknn_all_shifts_layer_max", f"{LCURVE} SELECT d, {S.r6('score')} AS score FROM mx")
def mknn_all_shifts_layer_max(spark, sf):
    return layer_max_curve(spark, sf).select("d", r6("score").alias("score"))


@query("mknn_all_shifts_per_subject",
       f"{SCURVE} SELECT subject, d, {S.r6('score')} AS score FROM cv")
def mknn_all_shifts_per_subject(spark, sf):
    return (layer_curve(spark, sf, B.SUBJECTS)
            .select("subject", "d", r6("score").alias("score")))


SHIFT_GRID = list(range(-50, 51))


@query("circular_curve", f"{LCURVE} SELECT s::BIGINT AS shift, {S.r6('score')} AS score "
       f"FROM (SELECT unnest({SHIFT_GRID}) AS s), nw, mx WHERE mx.d = ((s % n) + n) % n")
def circular_curve(spark, sf):
    """The curve at a chosen grid of signed shifts (zero always part of it)."""
    n = B.window_count(spark, sf)
    wanted = sorted({s % n for s in (0, *SHIFT_GRID)})
    return (layer_max_curve(spark, sf).filter(F.col("d").isin(wanted))
            .select(signed_shift(F.col("d"), n).alias("shift"), r6("score").alias("score")))


@query("model_pair_curves", f"WITH {S.model_spaces()}, {S.knn()}, {S.model_curve()} "
       f"SELECT a AS model_a, b AS model_b, d, {S.r6('score')} AS score FROM cv")
def model_pair_curves(spark, sf):
    return model_curves(spark, sf).select("model_a", "model_b", "d", r6("score").alias("score"))


# -- calibration --------------------------------------------------------------------

CAL_COLS = ["obs", "tau", "s_cal", "p", "null_mean", "excess"]


def rounded(df, keys, cols):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


def rsql(cols):
    return ", ".join(f"{S.r6(c)} AS {c}" for c in cols)


@query("calibrate_cyclic", f"{LCURVE}, {S.cyclic('(SELECT 0 AS q, * FROM mx)', 'q')} "
       f"SELECT {rsql(CAL_COLS)} FROM cal")
def calibrate_cyclic(spark, sf):
    return rounded(cal.calibrate_cyclic(layer_max_curve(spark, sf), ON,
                                        B.window_count(spark, sf)), [], CAL_COLS)


@query("calibrate_cyclic_per_subject", f"{SCURVE}, {S.cyclic('cv', 'subject')} "
       f"SELECT subject, {rsql(CAL_COLS)} FROM cal")
def calibrate_cyclic_per_subject(spark, sf):
    return rounded(cal.calibrate_cyclic(layer_curve(spark, sf, B.SUBJECTS), ["subject"],
                                        B.window_count(spark, sf)), ["subject"], CAL_COLS)


MCURVE = f"WITH {S.model_spaces()}, {S.knn()}, {S.model_curve()}"
MCAL = f"{MCURVE}, {S.cyclic('cv', 'a, b, fa, fb, ra, rb')}"


def model_calibration(spark, sf):
    return cal.calibrate_cyclic(
        model_curves(spark, sf),
        ["model_a", "model_b", "family_a", "family_b", "rank_a", "rank_b"],
        B.window_count(spark, sf))


@query("calibrate_model_pairs",
       f"{MCAL} SELECT a AS model_a, b AS model_b, {rsql(CAL_COLS)} FROM cal")
def calibrate_model_pairs(spark, sf):
    return rounded(model_calibration(spark, sf), ["model_a", "model_b"], CAL_COLS)


@query("calibrate_linear", f"{LCURVE} SELECT {S.r6('obs')} AS obs, {S.r6('tau')} AS tau, "
       f"{S.r6('CASE WHEN tau < 1 THEN greatest(obs - tau, 0.0) / (1 - tau) ELSE 0.0 END')} "
       f"AS s_cal, {S.r6('p')} AS p FROM (SELECT max(o) AS obs, "
       f"quantile_cont(score, 0.95) FILTER (d <> 0) AS tau, "
       f"(1 + count(*) FILTER (d <> 0 AND score >= o)) / count(*)::DOUBLE AS p "
       f"FROM (SELECT *, (SELECT score FROM mx WHERE d = 0) AS o FROM mx))")
def calibrate_linear(spark, sf):
    out = cal.calibrate_linear(layer_max_curve(spark, sf), ON, F.col("d") == 0,
                               F.col("d") != 0, ALPHA)
    return rounded(out, [], ["obs", "tau", "s_cal", "p"])


TAIL = 100
TAIL_COLS = ["obs", "tail_mean", "tail_sd", "z_tail", "p_tail"]


def tail_sql(src, keys):
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (f"tl AS (SELECT {k}d, score, n, abs({S.signed()}) >= {TAIL} AS tail, "
            f"{S.signed()} AS x, max(CASE WHEN d = 0 THEN score END) OVER ({part}) AS o "
            f"FROM {src}, nw), ts AS (SELECT {k}max(o) AS obs, avg(score) FILTER (tail) "
            f"AS tail_mean, stddev_samp(score) FILTER (tail) AS tail_sd, "
            f"count(*) FILTER (tail)::BIGINT AS n_tail, "
            f"(2 + count(*) FILTER (tail AND score >= o)) / (2 + count(*) FILTER (tail))"
            f"::DOUBLE AS p_tail, (max(o) - avg(score) FILTER (tail)) / "
            f"stddev_samp(score) FILTER (tail) AS z_tail, "
            f"(1 + count(*) FILTER (score >= o)) / (1 + count(*))::DOUBLE AS p_all, "
            f"regr_slope(score, x) * 1000 AS slope_k FROM tl {group})")


@query("tail_stats", f"{LCURVE}, {tail_sql('mx', '')} "
       f"SELECT n_tail, {rsql([*TAIL_COLS, 'p_all', 'slope_k'])} FROM ts")
def tail_stats(spark, sf):
    """Observed, tail moments, z, both p values and the drift slope (per 1000 windows)."""
    out = cal.shift_pvalues(layer_max_curve(spark, sf), ON, B.window_count(spark, sf), TAIL)
    return rounded(out.withColumn("slope_k", F.col("slope") * 1000), ["n_tail"],
                   [*TAIL_COLS, "p_all", "slope_k"])


@query("tail_stats_per_subject", f"{SCURVE}, {tail_sql('cv', 'subject')} "
       f"SELECT subject, n_tail, {rsql(TAIL_COLS)} FROM ts")
def tail_stats_per_subject(spark, sf):
    out = cal.tail_stats(layer_curve(spark, sf, B.SUBJECTS), ["subject"],
                         B.window_count(spark, sf), TAIL)
    return rounded(out, ["subject", "n_tail"], TAIL_COLS)


@query("tail_stats_subject_mean", f"{SCURVE}, sm AS (SELECT d, round(avg(score), 12) AS score "
       f"FROM cv GROUP BY d), {tail_sql('sm', '')} SELECT n_tail, {rsql(TAIL_COLS)} FROM ts")
def tail_stats_subject_mean(spark, sf):
    m = cal.mean_curve(layer_curve(spark, sf, B.SUBJECTS), ON).withColumn(
        "score", F.round("score", 12))
    return rounded(cal.tail_stats(m, ON, B.window_count(spark, sf), TAIL), ["n_tail"],
                   TAIL_COLS)


@query("excess_null", f"{MCURVE} SELECT a AS model_a, b AS model_b, "
       f"{S.r6('max(score) FILTER (d = 0) - avg(score) FILTER (d <> 0)')} AS excess "
       f"FROM cv GROUP BY 1, 2")
def excess_null(spark, sf):
    return (model_curves(spark, sf).groupBy("model_a", "model_b")
            .agg(r6(F.max(F.when(F.col("d") == 0, F.col("score")))
                    - F.avg(F.when(F.col("d") != 0, F.col("score")))).alias("excess")))


@query("null_percentiles", f"{SCURVE} SELECT subject, "
       f"{S.r6('quantile_cont(score, 0.05)')} AS p05, {S.r6('quantile_cont(score, 0.95)')} "
       f"AS p95 FROM cv, nw WHERE abs({S.signed()}) >= {TAIL} GROUP BY subject")
def null_percentiles(spark, sf):
    out = cal.null_percentiles(layer_curve(spark, sf, B.SUBJECTS), ["subject"],
                               cal.in_tail(B.window_count(spark, sf), TAIL),
                               {"p05": 0.05, "p95": 0.95})
    return rounded(out, ["subject"], ["p05", "p95"])


# families against every partner of another family; a pair seen from its other side is rotated back
FAM = (f"{MCURVE}, bo AS (SELECT fa, ra, b AS partner, fb, d, score FROM cv UNION ALL "
       f"SELECT fb, rb, a, fa, (n - d) % n, score FROM cv, nw), "
       f"fm AS (SELECT fa, ra, partner, d, score, n, abs({S.signed()}) >= {TAIL} AS tail "
       f"FROM bo, nw WHERE fa <> fb)")


def family_curves(spark, sf):
    """(family, size_rank, partner, d, score) for every model and every partner of other
    families."""
    n = B.window_count(spark, sf)
    views = F.explode(F.array(*[
        F.struct(F.col(f"family_{x}").alias("family"), F.col(f"rank_{x}").alias("size_rank"),
                 F.col(f"model_{y}").alias("partner"), F.col(f"family_{y}").alias("other"),
                 d.cast("bigint").alias("d"))
        for x, y, d in (("a", "b", F.col("d")), ("b", "a", modulo(-F.col("d"), n)))]))
    return (model_curves(spark, sf).select("score", views.alias("v")).select("v.*", "score")
            .filter("family != other").drop("other"))


@query("family_mean_z", f"{FAM}, zs AS (SELECT fa, ra, partner, avg(score) AS mu, "
       f"stddev_samp(score) AS sd FROM fm WHERE tail GROUP BY 1, 2, 3), "
       f"pd AS (SELECT fa, partner, d, tail, round(avg((score - mu) / sd), 12) AS z FROM fm "
       f"JOIN zs USING (fa, ra, partner) GROUP BY 1, 2, 3, 4), "
       f"ob AS (SELECT fa, partner, z AS zbar FROM pd WHERE d = 0) "
       f"SELECT fa AS family, partner, {S.r6('max(zbar)')} AS zbar, "
       f"{S.r6('(2 + count(*) FILTER (tail AND z >= zbar)) / (2 + count(*) FILTER (tail))')} "
       f"AS p FROM pd JOIN ob USING (fa, partner) GROUP BY fa, partner")
def family_mean_z(spark, sf):
    out = cal.family_mean_z(family_curves(spark, sf), ["size_rank"], ["family", "partner"],
                            B.window_count(spark, sf), TAIL)
    return rounded(out, ["family", "partner"], ["zbar", "p"])


@query("slope_null", f"{FAM}, sl AS (SELECT fa, partner, d, tail, "
       f"round(regr_slope(score, ra), 12) AS s FROM fm GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2), "
       f"ob AS (SELECT fa, partner, s AS o FROM sl WHERE d = 0) "
       f"SELECT fa AS family, partner, {S.r6('max(o)')} AS slope, "
       f"{S.r6('(1 + count(*) FILTER (tail AND s >= o)) / (1 + count(*) FILTER (tail))')} "
       f"AS p_slope FROM sl JOIN ob USING (fa, partner) GROUP BY fa, partner")
def slope_null(spark, sf):
    out = cal.slope_null(family_curves(spark, sf), ["family", "partner"], "size_rank",
                         B.window_count(spark, sf), TAIL)
    return rounded(out, ["family", "partner"], ["slope", "p_slope"])


# -- flagship -----------------------------------------------------------------------

@query("mknn_cyclic_null", f"{LCURVE}, {S.cyclic('(SELECT 0 AS q, * FROM mx)', 'q')}, "
       f"{tail_sql('mx', '')} SELECT {rsql(CAL_COLS)}, n_tail, "
       f"{rsql(['tail_mean', 'tail_sd', 'z_tail', 'p_tail'])} "
       f"FROM cal, (SELECT * EXCLUDE (obs) FROM ts)")
def mknn_cyclic_null(spark, sf):
    """Layer-maximised overlap, its cyclic calibration and its far-tail test."""
    n = B.window_count(spark, sf)
    curve = layer_max_curve(spark, sf)
    out = cal.calibrate_cyclic(curve, ON, n).join(
        cal.tail_stats(curve, ON, n, TAIL).drop("obs"), ON)
    return out.select(*[r6(c).alias(c) for c in CAL_COLS], "n_tail",
                      *[r6(c).alias(c) for c in ("tail_mean", "tail_sd", "z_tail", "p_tail")])


# -- CKA ----------------------------------------------------------------------------

CKA_SHIFTS = [0, 1, 7, 97]


def cka_sql(shifts, slots):
    n_rows = f"(SELECT unnest({shifts}) AS s)"
    return (f"WITH {S.spaces(slots)}, mu AS (SELECT side, layer, subject, f, avg(x) AS m FROM "
            f"(SELECT side, layer, subject, unnest(range(1, len(v) + 1)) AS f, "
            f"unnest(v) AS x FROM sp) GROUP BY ALL), "
            f"ex AS (SELECT side, layer, subject, w, unnest(range(1, len(v) + 1)) AS f, "
            f"unnest(v) AS x FROM sp), "
            f"c AS (SELECT ex.side, ex.layer, ex.subject, w, ex.f, x - m AS x FROM ex JOIN mu "
            f"ON ex.side = mu.side AND ex.layer = mu.layer AND ex.subject = mu.subject "
            f"AND ex.f = mu.f), "
            f"nr AS (SELECT side, layer, subject, sqrt(sum(q * q)) AS nr FROM (SELECT a.side, "
            f"a.layer, a.subject, a.f, b.f AS g, sum(a.x * b.x) AS q FROM c a JOIN c b "
            f"ON a.side = b.side AND a.layer = b.layer AND a.subject = b.subject "
            f"AND a.w = b.w GROUP BY ALL) GROUP BY ALL), "
            f"cr AS (SELECT subject, la, lb, s, sum(q * q) AS cr FROM (SELECT a.subject, "
            f"a.layer AS la, b.layer AS lb, s, a.f, b.f AS g, sum(a.x * b.x) AS q "
            f"FROM c a, c b, nw, {n_rows} t WHERE a.side = 'a' AND b.side = 'b' "
            f"AND a.subject = b.subject AND a.w = (b.w + s) % n GROUP BY ALL) GROUP BY ALL), "
            f"cka AS (SELECT cr.subject, la, lb, s::BIGINT AS shift, "
            f"cr / (x.nr * y.nr + 1e-20) AS cka FROM cr JOIN nr x ON x.side = 'a' "
            f"AND x.layer = la AND x.subject = cr.subject JOIN nr y ON y.side = 'b' "
            f"AND y.layer = lb AND y.subject = cr.subject) ")


def cka_side(spark, sf, which, slots):
    return B.side(spark, sf, which, slots, "la" if which == "a" else "lb")


@query("cka_d0", cka_sql([0], S.LAYERED)
       + f"SELECT la, lb, {S.r6('cka')} AS cka FROM cka")
def cka_d0(spark, sf):
    return (cka.cka_at_shifts(cka_side(spark, sf, "a", B.LAYERED),
                              cka_side(spark, sf, "b", B.LAYERED), ["la"], ["lb"],
                              ["grid"], B.window_count(spark, sf), [0])
            .select("la", "lb", r6("cka").alias("cka")))


@query("cka_shifts_sample", cka_sql(CKA_SHIFTS, S.PLAIN)
       + f"SELECT shift, {S.r6('cka')} AS cka FROM cka")
def cka_shifts_sample(spark, sf):
    return (cka.cka_at_shifts(cka_side(spark, sf, "a", B.PLAIN),
                              cka_side(spark, sf, "b", B.PLAIN), ["la"], ["lb"],
                              ["grid"], B.window_count(spark, sf), CKA_SHIFTS)
            .select(F.col("shift").cast("bigint").alias("shift"), r6("cka").alias("cka")))


@query("cka_gram", cka_sql(CKA_SHIFTS, S.PLAIN)
       + f"SELECT shift, {S.r6('cka')} AS cka FROM cka")
def cka_gram(spark, sf):
    """The same from window-by-window products, the form for spaces wider than they are long."""
    return (gram_cka(cka_side(spark, sf, "a", B.PLAIN), cka_side(spark, sf, "b", B.PLAIN),
                     ["la"], ["lb"], ["grid"], B.window_count(spark, sf), CKA_SHIFTS)
            .select(F.col("shift").cast("bigint").alias("shift"), r6("cka").alias("cka")))


@query("cka_per_subject", cka_sql([0], S.SUBJECTS)
       + f"SELECT subject, {S.r6('cka')} AS cka FROM cka")
def cka_per_subject(spark, sf):
    """Subjects are matched by id."""
    return (cka.cka_at_shifts(cka_side(spark, sf, "a", B.SUBJECTS),
                              cka_side(spark, sf, "b", B.SUBJECTS), ["la"], ["lb"],
                              ["grid", "subject"], B.window_count(spark, sf), [0])
            .select("subject", r6("cka").alias("cka")))


def cka_every(slots):
    """CKA at every rotation: whole series as lists, rotated by slicing the doubled list."""
    return (
        f"WITH {S.spaces(slots)}, ex AS (SELECT side, layer, w, unnest(range(1, len(v) + 1)) AS f, "
        f"unnest(v) AS x FROM sp), mu AS (SELECT side, layer, f, avg(x) AS m FROM ex GROUP BY ALL), "
        f"c AS (SELECT ex.side, ex.layer, ex.f, list(x - m ORDER BY w) AS xs FROM ex JOIN mu "
        f"ON ex.side = mu.side AND ex.layer = mu.layer AND ex.f = mu.f GROUP BY ALL), "
        f"nr AS (SELECT a.side, a.layer, sqrt(sum(list_dot_product(a.xs, b.xs) ** 2)) AS nr "
        f"FROM c a JOIN c b ON a.side = b.side AND a.layer = b.layer GROUP BY ALL), "
        f"cka AS (SELECT a.layer AS la, b.layer AS lb, s::BIGINT AS shift, "
        f"sum(list_dot_product(a.xs, list_concat(b.xs, b.xs)[n - s + 1:n - s + n]) ** 2) "
        f"/ (max(x.nr) * max(y.nr) + 1e-20) AS cka FROM c a, c b, nw, "
        f"(SELECT unnest(range(n)) AS s FROM nw) t, nr x, nr y "
        f"WHERE a.side = 'a' AND b.side = 'b' AND x.side = 'a' AND x.layer = a.layer "
        f"AND y.side = 'b' AND y.layer = b.layer GROUP BY ALL) ")


def cka_curve(spark, sf, slots):
    return cka.cka_all_shifts(cka_side(spark, sf, "a", slots), cka_side(spark, sf, "b", slots),
                              ["la"], ["lb"], ["grid"], B.window_count(spark, sf))


@query("cka_all_shifts", cka_every(S.PLAIN) + f"SELECT shift AS d, {S.r6('cka')} AS score FROM cka")
def cka_all_shifts(spark, sf):
    return cka_curve(spark, sf, B.PLAIN).select("d", r6("score").alias("score"))


@query("cka_all_shifts_layer_max", cka_every(S.LAYERED) + f"SELECT shift AS d, "
       f"{S.r6('max(cka)')} AS score FROM cka GROUP BY 1")
def cka_all_shifts_layer_max(spark, sf):
    return (shift_curve.max_over_layers(cka_curve(spark, sf, B.LAYERED), ["grid"])
            .select("d", r6("score").alias("score")))


@query("cka_calibrated", cka_every(S.PLAIN).rstrip() + ", cv AS (SELECT 0 AS q, shift AS d, "
       f"round(cka, 12) AS score FROM cka), {S.cyclic('cv', 'q')} "
       f"SELECT {rsql(CAL_COLS)} FROM cal")
def cka_calibrated(spark, sf):
    curve = cka_curve(spark, sf, B.PLAIN).withColumn("score", F.round("score", 12))
    return rounded(cal.calibrate_cyclic(curve, ["grid"], B.window_count(spark, sf)), [],
                   CAL_COLS)


# -- where alignment lives ----------------------------------------------------------

K_GRID, R_GRID = [5, 10, 20, 50], [0, 1, 2, 3, 5, 10]


@query("mknn_by_k", f"WITH {S.spaces()}, {S.knn(max(K_GRID))}, ks AS (SELECT unnest({K_GRID}) AS k) "
       f"SELECT k::BIGINT AS k, {S.r6('count(*) / (k * max(n))::DOUBLE')} AS mknn FROM ks, nw, "
       f"nn a JOIN nn b ON a.i = b.i AND a.j = b.j AND a.side = 'a' AND b.side = 'b' "
       f"WHERE a.rank <= k AND b.rank <= k GROUP BY k")
def mknn_by_k(spark, sf):
    """Overlap as the neighbourhood widens."""
    out = overlap.mknn_by_k(edges(spark, sf, "a", k=max(K_GRID)),
                            edges(spark, sf, "b", k=max(K_GRID)), ON,
                            B.window_count(spark, sf), K_GRID)
    return out.select(F.col("k").cast("bigint").alias("k"), r6("mknn").alias("mknn"))


@query("cka_without_top_directions")
def cka_without_top_directions(spark, sf):
    """CKA after deleting the strongest directions of both sides."""
    out = cka.cka_without_top(cka_side(spark, sf, "a", B.PLAIN), cka_side(spark, sf, "b", B.PLAIN),
                              ["la"], ["lb"], ["grid"], B.window_count(spark, sf), [0], R_GRID)
    return out.select("r", r6("cka").alias("cka"))
