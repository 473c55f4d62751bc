"""Queries on the shape of a space, on grids of windows, and on decodability."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochord.functions.vectors import dot, doubles, l2, r6, softmax
from isochord.operators import decode, geometry, knn, overlap, regrid, stats
from isochord.plans import bindings as B
from isochord.plans import sqltext as S
from isochord.plans.alignment import rounded
from isochord.plans.nulls import both_ways
from isochord.plans.registry import query
from isochord.session import written

# -- geometry ------------------------------------------------------------------------

FULL = [("a", 0, "s0", 1, 64)]
PLANE = [("a", 0, "s0", 1, 2)]


def whole(spark, sf):
    return B.side(spark, sf, "a", FULL).select("grid", "w", "vec")


EX = ("ex AS (SELECT side, layer, w, unnest(range(1, len(v) + 1)) AS f, unnest(v) AS x FROM sp), "
      "mu AS (SELECT side, layer, f, avg(x) AS m FROM ex GROUP BY ALL), "
      "c AS (SELECT ex.side, ex.layer, ex.w, ex.f, x - m AS x FROM ex JOIN mu "
      "ON ex.side = mu.side AND ex.layer = mu.layer AND ex.f = mu.f), "
      "cv AS (SELECT a.side, a.layer, a.f, b.f AS g, sum(a.x * b.x) AS q FROM c a JOIN c b "
      "ON a.side = b.side AND a.layer = b.layer AND a.w = b.w GROUP BY ALL)")


@query("participation_ratio", f"WITH {S.spaces(S.HALVES)}, {EX} SELECT layer AS la, "
       f"{S.r6('sum(q) FILTER (f = g) ** 2 / (sum(q * q) + 1e-12)')} AS participation_ratio "
       f"FROM cv WHERE side = 'a' GROUP BY 1")
def participation_ratio(spark, sf):
    return rounded(geometry.participation_ratio(B.side(spark, sf, "a", B.HALVES, "la"), ["la"]),
                   ["la"], ["participation_ratio"])


@query("twonn_id", f"WITH {S.spaces(FULL)}, {S.euclid(2)}, "
       f"m AS (SELECT max(CASE WHEN rank = 2 THEN dist END) / "
       f"greatest(max(CASE WHEN rank = 1 THEN dist END), 1e-12) AS mu FROM dd GROUP BY i), "
       f"r AS (SELECT mu, row_number() OVER (ORDER BY mu) AS rn, count(*) OVER () AS c FROM m "
       f"WHERE mu > 1 + 1e-12), k AS (SELECT *, greatest(c * 90 // 100, 4) AS n FROM r) "
       f"SELECT {S.r6('regr_slope(-ln(1 - rn / (n + 1)::DOUBLE), ln(mu))')} AS twonn_id, "
       f"max(n)::BIGINT AS n_kept FROM k WHERE rn <= n")
def twonn_id(spark, sf):
    return rounded(geometry.twonn_id(whole(spark, sf), ["grid"],
                                     n_windows=B.window_count(spark, sf)), ["n_kept"], ["twonn_id"])


@query("mle_id", f"WITH {S.spaces(FULL)}, {S.euclid(20)}, "
       f"l AS (SELECT i, rank, ln(greatest(dist, 1e-12)) AS ld, sum(ln(greatest(dist, 1e-12))) "
       f"OVER (PARTITION BY i ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
       f"AS b FROM dd), k AS (SELECT rank, avg(ld - b / (rank - 1)) AS inv FROM l "
       f"WHERE rank >= 10 GROUP BY 1) SELECT {S.r6('1 / avg(inv)')} AS mle_id FROM k")
def mle_id(spark, sf):
    return rounded(geometry.mle_id(whole(spark, sf), ["grid"],
                                     n_windows=B.window_count(spark, sf)), [], ["mle_id"])


@query("effective_rank")
def effective_rank(spark, sf):
    out = geometry.spectrum_stats(B.side(spark, sf, "a", B.HALVES, "la"), ["la"])
    return rounded(out, ["la"], ["participation_ratio", "effective_rank"])


@query("effective_rank_plane", f"WITH {S.spaces([('a', 0, 's0', 1, 2)])}, m AS (SELECT "
       f"var_pop(v[1]) * count(*) AS p, var_pop(v[2]) * count(*) AS q, "
       f"covar_pop(v[1], v[2]) * count(*) AS r FROM sp), ev AS (SELECT "
       f"(p + q + sqrt((p - q) ** 2 + 4 * r * r)) / 2 AS e1, "
       f"(p + q - sqrt((p - q) ** 2 + 4 * r * r)) / 2 AS e2 FROM m), "
       f"s AS (SELECT e1 / (e1 + e2) AS s1, e2 / (e1 + e2) AS s2, e1, e2 FROM ev) SELECT "
       f"{S.r6('(e1 + e2) ** 2 / (e1 * e1 + e2 * e2 + 1e-12)')} AS participation_ratio, "
       f"{S.r6('exp(-s1 * ln(s1) - s2 * ln(s2))')} AS effective_rank, {S.r6('s1')} AS top_share FROM s")
def effective_rank_plane(spark, sf):
    """Spectrum of two columns, whose eigenvalues plain SQL can solve."""
    out = geometry.spectrum_stats(B.side(spark, sf, "a", PLANE, "la"), ["la"], 2)
    return rounded(out.withColumn("top_share", F.col("eigenspectrum")[0]), [],
                   ["participation_ratio", "effective_rank", "top_share"])


@query("eigenspectrum")
def eigenspectrum(spark, sf):
    out = geometry.spectrum_stats(whole(spark, sf), ["grid"])
    return (out.select(F.posexplode("eigenspectrum").alias("place", "share"))
            .select("place", r6("share").alias("share")))


@query("local_twonn", f"WITH {S.spaces(FULL)}, {S.knn(20)}, "
       f"z AS (SELECT w, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS z "
       f"FROM sp), pd AS (SELECT a.i, a.j, list_distance(x.z, y.z) AS d FROM nn a JOIN nn b "
       f"ON a.i = b.i AND a.j <> b.j JOIN z x ON x.w = a.j JOIN z y ON y.w = b.j), "
       f"rk AS (SELECT i, j, d, row_number() OVER (PARTITION BY i, j ORDER BY d) AS r FROM pd), "
       f"m AS (SELECT i, max(CASE WHEN r = 2 THEN d END) / greatest(max(CASE WHEN r = 1 THEN d END), "
       f"1e-12) AS mu FROM rk WHERE r <= 2 GROUP BY i, j), "
       f"o AS (SELECT i, mu, row_number() OVER (PARTITION BY i ORDER BY mu) AS rn, "
       f"count(*) OVER (PARTITION BY i) AS c FROM m WHERE mu > 1 + 1e-12), "
       f"k AS (SELECT *, greatest(c * 90 // 100, 4) AS n FROM o) "
       f"SELECT i AS w, {S.r6('regr_slope(-ln(1 - rn / (n + 1)::DOUBLE), ln(mu))')} AS local_id "
       f"FROM k WHERE rn <= n GROUP BY i")
def local_twonn(spark, sf):
    return (geometry.local_twonn(whole(spark, sf), ["grid"],
                                     n_windows=B.window_count(spark, sf))
            .select(F.col("i").alias("w"), r6("local_id").alias("local_id")))


@query("zero_shot_labels", f"WITH {S.E}, ex AS (SELECT w, label, unnest(range(1, 65)) AS f, "
       f"unnest(v) AS x FROM e), ce AS (SELECT label, f, avg(x) AS x FROM ex GROUP BY 1, 2), "
       f"nm AS (SELECT label, sqrt(sum(x * x)) + 1e-12 AS l FROM ce GROUP BY 1), "
       f"lg AS (SELECT ex.w, ce.label, 20 * sum(ex.x * ce.x) / max(l) / (max(sqrt(list_dot_product("
       f"e.v, e.v))) + 1e-12) AS s FROM ex JOIN ce ON ex.f = ce.f JOIN nm ON nm.label = ce.label "
       f"JOIN e ON e.w = ex.w GROUP BY 1, 2) SELECT w, label::BIGINT AS label, "
       f"{S.r6('exp(s - max(s) OVER q) / sum(exp(s)) OVER q * exp(max(s) OVER q)')} AS p FROM lg "
       f"WINDOW q AS (PARTITION BY w)")
def zero_shot_labels(spark, sf):
    """Softmax over the similarity of a window to every label's direction (20 x cosine)."""
    emb = B.embeddings(spark, sf).withColumn("v", doubles("embedding"))
    # one array of label directions: as many entries as there are labels
    centres = (emb.select("label", F.posexplode("v").alias("pos", "x"))
               .groupBy("label", "pos").agg(F.avg("x").alias("x"))
               .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
               .select("label", l2(F.transform("c", lambda c: c["x"])).alias("c"))
               .agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centres")))
    scores = F.transform("centres", lambda c: 20.0 * dot(F.col("u"), c["c"]))
    labels = F.transform("centres", lambda c: c["label"])
    pairs = F.arrays_zip(labels.alias("label"), softmax(scores).alias("p"))
    return (emb.select("w", l2(F.col("v")).alias("u")).join(F.broadcast(centres))
            .select("w", F.explode(pairs).alias("s"))
            .select("w", F.col("s.label").cast("bigint").alias("label"), r6("s.p").alias("p")))


# -- grids ---------------------------------------------------------------------------

@query("subject_mean", "WITH " + S.spaces(S.EIGHTHS) + " SELECT w, pos, "
       + S.r6("avg(x)") + " AS x FROM (SELECT w, unnest(range(1, len(v) + 1)) AS pos, "
       "unnest(v) AS x FROM sp WHERE side = 'a') GROUP BY 1, 2")
def subject_mean(spark, sf):
    m = regrid.subject_mean(B.side(spark, sf, "a", B.EIGHTHS), ["grid", "w"])
    return (m.select("w", F.posexplode("vec").alias("pos", "x"))
            .select("w", (F.col("pos") + 1).cast("bigint").alias("pos"), r6("x").alias("x")))


NATIVE_SEC = 6


@query("regrid_common", f"WITH {S.E}, b AS (SELECT least(floor((w + 0.5) * {NATIVE_SEC} / 10)::BIGINT, "
       f"n * {NATIVE_SEC} // 10 - 1) AS b, v FROM e, nw), g AS (SELECT unnest(range(n * {NATIVE_SEC} // 10)) "
       f"AS w FROM nw), m AS (SELECT b, pos, avg(x) AS x FROM (SELECT b, "
       f"unnest(range(1, 65)) AS pos, unnest(v) AS x FROM b) GROUP BY 1, 2), "
       f"p AS (SELECT unnest(range(1, 65)) AS pos) SELECT g.w, p.pos, "
       f"{S.r6('coalesce(m.x, 0)')} AS x FROM g, p LEFT JOIN m ON m.b = g.w AND m.pos = p.pos")
def regrid_common(spark, sf):
    n_common = B.window_count(spark, sf) * NATIVE_SEC // 10
    out = regrid.to_common(whole(spark, sf), ["grid"], NATIVE_SEC, n_common)
    return (out.select("w", F.posexplode("vec").alias("pos", "x"))
            .select("w", (F.col("pos") + 1).cast("bigint").alias("pos"), r6("x").alias("x")))


# two recordings whose windows last 5 s and 6 s
TWO_SEC = {"a": 5, "b": 6}


def binned_sql(side: str) -> str:
    """Windows of one side as means over bins of 10 s."""
    sec, first = TWO_SEC[side], 1 if side == "a" else 33
    bins = f"n * {sec} // 10"
    return (f"b{side} AS (SELECT '{side}' AS side, w, list(x ORDER BY pos) AS v FROM (SELECT "
            f"least(floor((w + 0.5) * {sec} / 10)::BIGINT, {bins} - 1) AS w, pos, avg(x) AS x "
            f"FROM (SELECT w, n, unnest(range(32)) AS pos, unnest(v[{first}:{first + 31}]) AS x "
            f"FROM e, nw) GROUP BY 1, 2) GROUP BY w)")


@query("mknn_native_grids", f"WITH {S.E}, {binned_sql('a')}, {binned_sql('b')}, "
       f"wn AS (SELECT least(n * {TWO_SEC['a']} // 10, n * {TWO_SEC['b']} // 10) AS common FROM nw), "
       f"sp AS (SELECT side, 0 AS layer, 's0' AS subject, w, v FROM (SELECT * FROM ba UNION ALL "
       f"SELECT * FROM bb), wn WHERE w < common), {S.knn()} "
       f"SELECT max(common)::BIGINT AS n_windows, {S.r6(f'count(*) / (max(common) * {B.K})::DOUBLE')} AS mknn "
       f"FROM nn a JOIN nn b ON a.i = b.i AND a.j = b.j AND a.side = 'a' AND b.side = 'b', wn")
def mknn_native_grids(spark, sf):
    """Overlap of recordings on different grids: both to the common bins, as many as both have."""
    n = B.window_count(spark, sf)
    bins = {x: n * sec // 10 for x, sec in TWO_SEC.items()}
    n_common = min(bins.values())
    edges = {x: knn.knn_edges(
        regrid.to_common(B.side(spark, sf, x).select("grid", "w", "vec"), ["grid"], sec, bins[x])
        .filter(F.col("w") < n_common).withColumn(f"l{x}", F.lit(0)), ["grid", f"l{x}"], B.K,
        n_windows=n_common) for x, sec in TWO_SEC.items()}
    out = overlap.mknn(edges["a"], edges["b"], ["la"], ["lb"], ["grid"], n_common, B.K)
    return out.select(F.lit(n_common).cast("bigint").alias("n_windows"), r6("mknn").alias("mknn"))


POOL_SEC, POOL_SHIFT = 4, 6
POOL_N = f"((n * 4) // (5 * {POOL_SEC}))"


@query("window_pool", f"WITH {S.E}, t AS (SELECT w AS tr, (w + 0.5) * 0.8 AS c, v FROM e), "
       f"g AS (SELECT unnest(range({POOL_N})) AS w FROM nw), "
       f"i AS (SELECT g.w, t.v FROM g JOIN t ON c >= g.w * {POOL_SEC} + {POOL_SHIFT}.0 "
       f"AND c < (g.w + 1) * {POOL_SEC} + {POOL_SHIFT}.0), "
       f"z AS (SELECT w, v FROM i UNION ALL SELECT g.w, t.v FROM g, nw, t WHERE g.w NOT IN "
       f"(SELECT w FROM i) AND t.tr = least(n - 1, "
       f"round_even((g.w * {POOL_SEC} + {POOL_SHIFT}) / 0.8::DOUBLE, 0)::BIGINT)) "
       f"SELECT w, pos, {S.r6('avg(x)')} AS x FROM (SELECT w, unnest(range(1, 65)) AS pos, "
       f"unnest(v) AS x FROM z) GROUP BY 1, 2")
def window_pool(spark, sf):
    n = B.window_count(spark, sf)
    scans = whole(spark, sf).withColumnRenamed("w", "tr")
    out = regrid.window_pool(scans, ["grid"], POOL_SEC, POOL_SHIFT,
                             n * 4 // (5 * POOL_SEC), n)
    return (out.select("w", F.posexplode("vec").alias("pos", "x"))
            .select("w", (F.col("pos") + 1).cast("bigint").alias("pos"), r6("x").alias("x")))


def clips(spark, sf, *cols):
    """Documents in id order stand in for captions: one per 4 s clip."""
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("clip"), *cols)


def clip_count(spark, sf):
    return B.row_count(spark, sf, "documents")


CLIPS = "cl AS (SELECT doc_id AS clip, text, n_chars FROM documents), nc AS (SELECT count(*)::BIGINT AS n FROM documents)"


@query("interval_overlap", f"WITH {CLIPS}, g AS (SELECT s.win, unnest(range(n * 4 // win)) AS w FROM nc, "
       f"(SELECT unnest([5, 6, 8, 10])::BIGINT AS win) s) SELECT win, w, clip FROM g JOIN cl "
       f"ON clip * 4 < (w + 1) * win AND clip * 4 + 4 > w * win")
def interval_overlap(spark, sf):
    n = clip_count(spark, sf)
    out = None
    for win in (5, 6, 8, 10):
        one = regrid.clips_to_windows(clips(spark, sf), win, n * 4 // win).select(
            F.lit(win).cast("bigint").alias("win"), "w", "clip")
        out = one if out is None else out.union(one)
    return out


@query("window_texts", f"WITH {CLIPS}, g AS (SELECT unnest(range(n * 4 // 10)) AS w FROM nc) "
       f"SELECT w, md5(string_agg(text, ' ' ORDER BY clip)) AS digest, count(*)::BIGINT AS n_caps "
       f"FROM g JOIN cl ON clip * 4 < (w + 1) * 10 AND clip * 4 + 4 > w * 10 GROUP BY w")
def window_texts(spark, sf):
    n = clip_count(spark, sf)
    return (regrid.window_texts(clips(spark, sf, "text"), 10, n * 4 // 10)
            .select("w", F.md5("text").alias("digest"), "n_caps"))


FRAMES = (f"{CLIPS}, g AS (SELECT unnest(range(n * 4 // 6)) AS w FROM nc), "
          f"fr AS (SELECT w, clip, greatest(0, floor((greatest(w * 6, clip * 4) - clip * 4) "
          f"/ 4 * n_chars))::BIGINT AS f_start, least(n_chars, "
          f"ceil((least((w + 1) * 6, clip * 4 + 4) - clip * 4) / 4 * n_chars))::BIGINT AS f_end "
          f"FROM g JOIN cl ON clip * 4 < (w + 1) * 6 AND clip * 4 + 4 > w * 6)")


def frame_ranges(spark, sf):
    n = clip_count(spark, sf)
    return regrid.window_frames(clips(spark, sf, F.col("n_chars").alias("n_frames")), 6,
                                n * 4 // 6)


@query("window_frames", f"WITH {FRAMES} SELECT w, clip, f_start, f_end FROM fr "
       f"WHERE f_end > f_start")
def window_frames(spark, sf):
    return frame_ranges(spark, sf).select("w", "clip", "f_start", "f_end")


@query("frame_samples", f"WITH {FRAMES}, t AS (SELECT w, sum(f_end - f_start)::BIGINT AS n FROM fr "
       f"GROUP BY 1) SELECT w, i::BIGINT AS place, CASE WHEN i = 15 THEN n - 1 ELSE "
       f"trunc(i * ((n - 1) / 15.0::DOUBLE))::BIGINT END AS frame FROM t, "
       f"(SELECT unnest(range(16)) AS i)")
def frame_samples(spark, sf):
    total = frame_ranges(spark, sf).groupBy("w").agg(
        F.sum(F.col("f_end") - F.col("f_start")).alias("n"))
    return (total.select("w", F.posexplode(regrid.sampled_positions(F.col("n"), 16))
                         .alias("place", "frame"))
            .withColumn("place", F.col("place").cast("bigint")))


@query("scan_inventory", "SELECT quality, count(*)::BIGINT AS n_ids, min(doc_id) AS lo, "
       "max(doc_id) AS hi, max(doc_id) - min(doc_id) + 1 = count(*) AS contiguous, "
       "((SELECT count(*) FROM documents) - count(*))::BIGINT AS n_missing "
       "FROM (SELECT DISTINCT quality, doc_id FROM labels) GROUP BY 1")
def scan_inventory(spark, sf):
    ids = B.table(spark, sf, "labels").select("quality", F.col("doc_id").alias("id"))
    return regrid.scan_inventory(ids, ["quality"], clip_count(spark, sf))


@query("missing_scans", "SELECT quality, id FROM (SELECT DISTINCT quality FROM labels), "
       "(SELECT unnest(range((SELECT count(*) FROM documents)))::BIGINT AS id) "
       "EXCEPT SELECT quality, doc_id FROM labels")
def missing_scans(spark, sf):
    ids = B.table(spark, sf, "labels").select("quality", F.col("doc_id").alias("id"))
    return regrid.missing_scans(ids, ["quality"], clip_count(spark, sf))


# -- decodability --------------------------------------------------------------------

TARGETS = ["label", "label_zero", "n_chars"]


def window_targets(spark, sf):
    """Per window: its label, whether it is zero, and the length of the document at its place."""
    docs = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("w"), F.col("n_chars").cast("double").alias("n_chars"))
    emb = B.embeddings(spark, sf).select(
        "w", F.lit("base").alias("grid"), F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("label_zero"))
    return decode.clean_features(emb.join(docs, "w", "left"), ["grid"], TARGETS)


def layer_r2(spark, sf):
    return decode.ridge_r2(B.side(spark, sf, "a", B.HALVES, "la"), window_targets(spark, sf),
                           ["grid", "la"], ["grid"], TARGETS, B.window_count(spark, sf))


@query("ridge_cv_r2")
def ridge_cv_r2(spark, sf):
    return rounded(layer_r2(spark, sf), ["la", "feature"], ["r2"])


PENALTIES = ", ".join(repr(float(a)) for a in decode.ALPHAS)


@query("ridge_cv_r2_plane", f"WITH {S.spaces(PLANE)}, x AS (SELECT w, v[1] / (sqrt(list_dot_product(v, v)) "
       f"+ 1e-12) AS x1, v[2] / (sqrt(list_dot_product(v, v)) + 1e-12) AS x2 FROM sp), "
       f"t0 AS (SELECT e.w, label::DOUBLE AS label, (label = 0)::INT::DOUBLE AS label_zero, "
       f"coalesce(d.n_chars, avg(d.n_chars) OVER ())::DOUBLE AS n_chars FROM e LEFT JOIN documents d "
       f"ON d.doc_id = e.w), tg AS (SELECT w, unnest(['label', 'label_zero', 'n_chars']) AS feature, "
       f"unnest([label, label_zero, n_chars]) AS y FROM t0), "
       f"al AS (SELECT x.*, feature, y, (w >= n // 5)::INT + (w >= n * 2 // 5)::INT + "
       f"(w >= n * 3 // 5)::INT + (w >= n * 4 // 5)::INT AS fold FROM x JOIN tg USING (w), nw), "
       f"fo AS (SELECT unnest(range(5)) AS f), "
       f"tr AS (SELECT f, feature, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) + 1e-8 AS s1, "
       f"stddev_pop(x2) + 1e-8 AS s2, avg(y) AS ym FROM al, fo WHERE fold <> f GROUP BY 1, 2), "
       f"g AS (SELECT f, feature, sum(((x1 - m1) / s1) ** 2) AS g11, sum(((x2 - m2) / s2) ** 2) AS g22, "
       f"sum((x1 - m1) / s1 * (x2 - m2) / s2) AS g12, sum((x1 - m1) / s1 * (y - ym)) AS c1, "
       f"sum((x2 - m2) / s2 * (y - ym)) AS c2 FROM al JOIN tr USING (feature) WHERE fold <> f "
       f"GROUP BY 1, 2), "
       f"b AS (SELECT g.f, g.feature, a, ((g22 + a) * c1 - g12 * c2) / ((g11 + a) * (g22 + a) - g12 * g12) "
       f"AS b1, ((g11 + a) * c2 - g12 * c1) / ((g11 + a) * (g22 + a) - g12 * g12) AS b2 FROM g, "
       f"(SELECT unnest([{PENALTIES}]::DOUBLE[]) AS a)), "
       f"r AS (SELECT b.f, b.feature, b.a, greatest(-10.0, least(1.0, 1 - sum((y - ym - b1 * (x1 - m1) / s1 "
       f"- b2 * (x2 - m2) / s2) ** 2) / (var_pop(y) * count(*) + 1e-12))) AS r2 FROM b JOIN tr "
       f"ON tr.f = b.f AND tr.feature = b.feature JOIN al ON al.feature = b.feature AND al.fold = b.f "
       f"GROUP BY 1, 2, 3 HAVING var_pop(y) > 1e-9), "
       f"m AS (SELECT feature, a, avg(r2) AS r2 FROM r GROUP BY 1, 2) "
       f"SELECT feature, {S.r6('max(r2)')} AS r2 FROM m GROUP BY 1")
def ridge_cv_r2_plane(spark, sf):
    """Cross-validated ridge from two columns, small enough to be solved in plain SQL."""
    emb = B.side(spark, sf, "a", PLANE, "la")
    return rounded(decode.ridge_r2(emb, window_targets(spark, sf), ["grid", "la"], ["grid"], TARGETS,
                                   B.window_count(spark, sf)), ["feature"], ["r2"])


@query("decodability")
def decodability(spark, sf):
    return rounded(decode.decodability(layer_r2(spark, sf), ["grid"]), [], ["decodability"])


@query("fold_sizes", f"WITH {S.E} SELECT fold, count(*)::BIGINT AS n_windows FROM (SELECT "
       f"(w >= n // 5)::BIGINT + (w >= n * 2 // 5)::BIGINT + (w >= n * 3 // 5)::BIGINT + "
       f"(w >= n * 4 // 5)::BIGINT AS fold FROM e, nw) GROUP BY 1")
def fold_sizes(spark, sf):
    n = B.window_count(spark, sf)
    return (B.embeddings(spark, sf)
            .groupBy(decode.fold_of(F.col("w"), n).cast("bigint").alias("fold"))
            .agg(F.count(F.lit(1)).alias("n_windows")))


@query("alignment_vs_decodability")
def alignment_vs_decodability(spark, sf):
    """Family-centred decodability against family-centred cross-family excess."""
    emb = B.models(spark, sf)
    r2 = decode.ridge_r2(emb, window_targets(spark, sf), ["grid", "model"], ["grid"], TARGETS,
                         B.window_count(spark, sf))
    x = decode.decodability(r2, ["model"])
    y = (both_ways(spark, sf).filter("family != other_family").groupBy("model", "family")
         .agg(F.avg("excess").alias("excess")))
    both = stats.centred(stats.centred(x.join(y, "model"), ["family"], "decodability", "x"),
                         ["family"], "excess", "y")
    both = written(both, "alignment-decodability")  # one row per model, read several times
    rho = stats.spearman(both, [], "x", "y", bounds_x=[0.0], bounds_y=[0.0])
    slope = stats.ols_slope(both, [], "x", "y")
    return rounded(rho.join(F.broadcast(slope)), ["n"], ["rho", "p", "slope"])
