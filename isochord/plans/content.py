"""Queries on captions and on signal windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochord.functions import filters
from isochord.functions.vectors import r6
from isochord.operators import signal, stats, text
from isochord.plans import bindings as B
from isochord.plans import sqltext as S
from isochord.plans.alignment import rounded
from isochord.plans.registry import query
from isochord.session import inline


def documents(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "text")


# -- captions ------------------------------------------------------------------------

def hits_sql(words: list[str]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)


HITS = ("h AS (SELECT doc_id, " + ", ".join(f"({hits_sql(w)})::BIGINT AS {n}"
                                           for n, w in text.LEXICONS.items())
        + " FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents))")
NAMES = list(text.LEXICONS)


@query("caption_hits", f"WITH {HITS} SELECT doc_id, {', '.join(NAMES)} FROM h")
def caption_hits(spark, sf):
    return text.caption_hits(documents(spark, sf))


@query("caption_attributes", f"WITH {HITS} SELECT doc_id, "
       + ", ".join(f"{S.r6(f'({n} - avg({n}) OVER ()) / (stddev_pop({n}) OVER () + 1e-9)')} AS {n}"
                   for n in NAMES) + " FROM h")
def caption_attributes(spark, sf):
    return rounded(text.caption_attributes(documents(spark, sf)), ["doc_id"], NAMES)


STOP = ", ".join(f"'{w}'" for w in text.MINING_STOP_WORDS)


@query("tfidf", "WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), "
       "'[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), "
       f"tf AS (SELECT doc_id, term, count(*) AS tf FROM tk WHERE term NOT IN ({STOP}) "
       "GROUP BY 1, 2), vo AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 "
       "ORDER BY total DESC, term LIMIT 4096), "
       "w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / "
       "(1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN vo USING (term)) "
       f"SELECT doc_id, term, {S.r6('raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))')} "
       "AS weight FROM w")
def tfidf(spark, sf):
    return rounded(text.tfidf(documents(spark, sf), "doc_id", "text", text.MINING_STOP_WORDS),
                   ["doc_id", "term"], ["weight"])


WORD_LEXICON = sorted({(w, name) for name, words in text.LEXICONS.items() for w in words
                       if " " not in w})
WORD_ROWS = ", ".join(f"('{w}', '{c}')" for w, c in WORD_LEXICON)


@query("lexicon_scores", f"WITH lx(word, category) AS (VALUES {WORD_ROWS}), "
       "tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word "
       "FROM documents), tot AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1) "
       f"SELECT doc_id, category, {S.r6('count(*) / max(n)::DOUBLE')} AS score FROM tk "
       "JOIN lx USING (word) JOIN tot USING (doc_id) GROUP BY 1, 2")
def lexicon_scores(spark, sf):
    lexicon = inline(spark, WORD_LEXICON, ["word", "category"])
    return rounded(text.lexicon_scores(documents(spark, sf), "doc_id", lexicon),
                   ["doc_id", "category"], ["score"])


KNOWN = ", ".join(f"'{w}'" for w in text.MINING_STOP_WORDS + text.OBJECT_LABELS
                  + text.SCENE_LABELS + text.ACTION_LABELS)


@query("label_mining", "WITH tk AS (SELECT doc_id, unnest(ws) AS word, "
       "unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), "
       "'[a-z]{4,}') AS ws FROM documents)), c AS (SELECT word, count(*)::BIGINT AS n, "
       "min(doc_id * 10000000 + pos) AS f FROM tk "
       f"WHERE word NOT IN ({KNOWN}) GROUP BY 1) SELECT word, n FROM c ORDER BY n DESC, f LIMIT 30")
def label_mining(spark, sf):
    return text.mined_labels(documents(spark, sf), "doc_id")


def fixed_labels_sql() -> str:
    kinds = (("object", text.OBJECT_LABELS), ("scene", text.SCENE_LABELS),
             ("action", text.ACTION_LABELS))
    return ", ".join(f"('{w}', '{kind}')" for kind, words in kinds for w in words)


@query("label_bank", "WITH tk AS (SELECT doc_id, unnest(ws) AS word, "
       "unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), "
       "'[a-z]{4,}') AS ws FROM documents)), c AS (SELECT word, count(*)::BIGINT AS n, "
       "min(doc_id * 10000000 + pos) AS f FROM tk "
       f"WHERE word NOT IN ({KNOWN}) GROUP BY 1) SELECT word AS label, 'mined' AS kind FROM "
       "(SELECT word FROM c ORDER BY n DESC, f LIMIT 30) UNION ALL "
       f"SELECT * FROM (VALUES {fixed_labels_sql()})")
def label_bank(spark, sf):
    """Fixed objects, scenes and actions, and the words mined from all texts."""
    return text.label_bank(documents(spark, sf), "doc_id")


@query("clip_ids", "SELECT page_id, regexp_replace(regexp_replace(split_part(url, '/', -1), "
       "'\\.[^.]*$', ''), '\\D', '', 'g') AS digits FROM pages")
def clip_ids(spark, sf):
    """Digits of the last path component, as clips are numbered by their file name."""
    stem = F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"\.[^.]*$", "")
    return B.table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(stem, r"\D", "").alias("digits"))


# -- signals -------------------------------------------------------------------------

BIN_SEC, LENGTH, FS = 600, 128, 128.0
SIG = (f"bn AS (SELECT event_type AS ch, (epoch_us(ts) // {BIN_SEC * 1000000} - "
       f"(SELECT min(epoch_us(ts) // {BIN_SEC * 1000000}) FROM events))::BIGINT AS t, "
       f"avg(value) AS x FROM events GROUP BY 1, 2), "
       f"gr AS (SELECT ch, unnest(range((SELECT max(t) + 1 FROM bn))) AS t FROM "
       f"(SELECT DISTINCT ch FROM bn)), "
       f"sg AS (SELECT gr.ch, gr.t, coalesce(bn.x, avg(bn.x) OVER (PARTITION BY gr.ch), 0) AS x "
       f"FROM gr LEFT JOIN bn ON gr.ch = bn.ch AND gr.t = bn.t), "
       f"sw AS (SELECT *, t // {LENGTH} AS w FROM sg WHERE (t // {LENGTH} + 1) * {LENGTH} <= "
       f"(SELECT max(t) + 1 FROM bn))")


def regular_signal(spark, sf):
    """(ch, t, x): mean event value per channel and ten minutes, gaps filled with the mean."""
    ev = B.table(spark, sf, "events").select("event_type", "ts", "value")
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(BIN_SEC * 1000000)).cast("bigint")
    binned = (ev.groupBy(F.col("event_type").alias("ch"), slot.alias("slot"))
              .agg(F.avg("value").alias("x")))
    span = binned.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    slots = F.explode(F.sequence(F.col("lo"), F.col("hi")))
    every = (binned.select("ch").distinct().join(F.broadcast(span))
             .select("ch", "lo", slots.alias("slot")))
    filled = every.join(binned, ["ch", "slot"], "left")
    return (stats.mean_imputed(filled, ["ch"], "x")
            .select("ch", (F.col("slot") - F.col("lo")).alias("t"), "x"))


def signal_windows(spark, sf):
    return signal.windows_of(regular_signal(spark, sf), ["ch"], LENGTH)


@query("regular_signal", f"WITH {SIG} SELECT ch, t, {S.r6('x')} AS x FROM sg")
def regular_signal_query(spark, sf):
    return rounded(regular_signal(spark, sf), ["ch", "t"], ["x"])


@query("hjorth", f"WITH {SIG}, d1 AS (SELECT *, x - lag(x) OVER p AS a FROM sw "
       f"WINDOW p AS (PARTITION BY ch, w ORDER BY t)), d2 AS (SELECT *, a - lag(a) OVER p AS b "
       f"FROM d1 WINDOW p AS (PARTITION BY ch, w ORDER BY t)), "
       f"v AS (SELECT ch, w, var_pop(x) + 1e-20 AS v0, var_pop(a) + 1e-20 AS v1, "
       f"var_pop(b) + 1e-20 AS v2 FROM d2 GROUP BY 1, 2) SELECT ch, w, "
       f"{S.r6('sqrt(v1 / v0)')} AS hjorth_mobility, "
       f"{S.r6('sqrt(v2 / v1) / sqrt(v1 / v0)')} AS hjorth_complexity FROM v")
def hjorth(spark, sf):
    return rounded(signal.hjorth(signal_windows(spark, sf)), ["ch", "w"],
                   ["hjorth_mobility", "hjorth_complexity"])


@query("perm_entropy", f"WITH {SIG}, p AS (SELECT ch, w, (x > lead(x) OVER q)::INT + "
       f"2 * (x > lead(x, 2) OVER q)::INT + 4 * (lead(x) OVER q > lead(x, 2) OVER q)::INT AS c "
       f"FROM sw WINDOW q AS (PARTITION BY ch, w ORDER BY t)), "
       f"k AS (SELECT ch, w, c, count(*) / sum(count(*)) OVER (PARTITION BY ch, w) AS pr FROM p "
       f"WHERE c IS NOT NULL GROUP BY 1, 2, 3) SELECT ch, w, "
       f"{S.r6('-sum(pr * ln(pr)) / ln(6.0)')} AS perm_entropy FROM k GROUP BY 1, 2")
def perm_entropy(spark, sf):
    return rounded(signal.permutation_entropy(signal_windows(spark, sf)), ["ch", "w"],
                   ["perm_entropy"])


@query("median_over_channels", f"WITH {SIG}, s AS (SELECT ch, w, avg(x) AS m, stddev_pop(x) AS sd "
       f"FROM sw GROUP BY 1, 2) SELECT w, {S.r6('median(m)')} AS m, {S.r6('median(sd)')} AS sd "
       f"FROM s GROUP BY 1")
def median_over_channels(spark, sf):
    s = (regular_signal(spark, sf)
         .groupBy("ch", F.floor(F.col("t") / LENGTH).cast("bigint").alias("w"))
         .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
         .filter(F.col("n") == LENGTH))
    return s.groupBy("w").agg(r6(F.median("m")).alias("m"), r6(F.median("sd")).alias("sd"))


PAIRS = [("error", "click"), ("view", "signup"), ("click", "purchase")]


@query("bipolar_iqr", f"WITH {SIG}, pr(pair, a, c) AS (VALUES (0, 'error', 'click'), "
       f"(1, 'view', 'signup'), (2, 'click', 'purchase')), "
       f"d AS (SELECT pair, w, x.t, x.x - y.x AS x FROM pr JOIN sw x ON x.ch = a JOIN sg y "
       f"ON y.ch = c AND y.t = x.t), q AS (SELECT pair, w, quantile_cont(x, 0.25) AS lo, "
       f"quantile_cont(x, 0.75) AS hi FROM d GROUP BY 1, 2) SELECT pair::BIGINT AS pair, t, "
       f"{S.r6('greatest(least((x - lo) / (hi - lo + 1e-8), 20.0), -20.0)')} AS z FROM d "
       f"JOIN q USING (pair, w)")
def bipolar_iqr(spark, sf):
    """Channel differences, scaled by quartiles per window and clipped."""
    sig = regular_signal(spark, sf)
    n = F.floor(F.col("t") / LENGTH).cast("bigint")
    d = signal.bipolar(sig, ["t"], "ch", PAIRS).withColumn("w", n)
    full = d.groupBy("w").agg(F.max("t").alias("last")).filter(
        F.col("last") == (F.col("w") + 1) * LENGTH - 1).select("w")
    out = stats.iqr_scaled(d.join(full, "w"), ["pair", "w"], "x", "z", bounded=True)
    return out.select(F.col("pair").cast("bigint").alias("pair"), "t", r6("z").alias("z"))


@query("spectral_edge", f"WITH p AS (SELECT user_id, hour(ts)::BIGINT AS freq, sum(value) AS power "
       f"FROM events GROUP BY 1, 2), c AS (SELECT *, sum(power) OVER (PARTITION BY user_id "
       f"ORDER BY freq) / (sum(power) OVER (PARTITION BY user_id) + 1e-20) AS cum FROM p) "
       f"SELECT user_id, coalesce(min(freq) FILTER (cum >= 0.9), max(freq)) AS edge FROM c "
       f"GROUP BY 1")
def spectral_edge(spark, sf):
    spectrum = (B.table(spark, sf, "events")
                .groupBy("user_id", F.hour("ts").cast("bigint").alias("freq"))
                .agg(F.sum("value").alias("power")))
    return signal.spectral_edge(spectrum, ["user_id"], 0.9)


SPECTRAL = [n for n in signal.FEATURES if n not in ("pe_theta", "pe_alpha")]
BAND_SQL = ", ".join(f"ln(sum(p) FILTER (f >= {lo} AND f < {hi}) + 1e-20) AS abs_{n}, "
                     f"sum(p) FILTER (f >= {lo} AND f < {hi}) / (sum(p) + 1e-20) AS rel_{n}"
                     for n, (lo, hi) in signal.BANDS.items())


@query("spectral_features", f"WITH {SIG}, x AS (SELECT ch, w, t % {LENGTH} AS k, "
       f"(x - avg(x) OVER (PARTITION BY ch, w)) * (0.5 - 0.5 * cos(2 * pi() * (t % {LENGTH}) / "
       f"{LENGTH})) AS y FROM sw), ps AS (SELECT ch, w, f, 2 * (sum(y * cos(2 * pi() * f * k / "
       f"{LENGTH})) ** 2 + sum(y * sin(2 * pi() * f * k / {LENGTH})) ** 2) / ({FS} * "
       f"(SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / {LENGTH})) ** 2) FROM "
       f"(SELECT unnest(range({LENGTH})) AS i))) AS p FROM x, "
       f"(SELECT unnest(range(1, 31)) AS f) GROUP BY 1, 2, 3), "
       f"cu AS (SELECT *, sum(p) OVER (PARTITION BY ch, w ORDER BY f) / (sum(p) OVER "
       f"(PARTITION BY ch, w) + 1e-20) AS cum, p / (sum(p) OVER (PARTITION BY ch, w) + 1e-20) AS s "
       f"FROM ps), sp AS (SELECT ch, w, {BAND_SQL}, -sum(s * ln(s + 1e-20)) / ln(30) AS spec_entropy, "
       f"coalesce(min(f) FILTER (cum >= 0.5), 30) AS median_freq, "
       f"coalesce(min(f) FILTER (cum >= 0.9), 30) AS spec_edge90 FROM cu GROUP BY 1, 2), "
       f"d1 AS (SELECT *, x - lag(x) OVER q AS a, (x > lead(x) OVER q)::INT + 2 * "
       f"(x > lead(x, 2) OVER q)::INT + 4 * (lead(x) OVER q > lead(x, 2) OVER q)::INT AS c FROM sw "
       f"WINDOW q AS (PARTITION BY ch, w ORDER BY t)), d2 AS (SELECT *, a - lag(a) OVER q AS b "
       f"FROM d1 WINDOW q AS (PARTITION BY ch, w ORDER BY t)), "
       f"hj AS (SELECT ch, w, sqrt((var_pop(a) + 1e-20) / (var_pop(x) + 1e-20)) AS hjorth_mobility, "
       f"sqrt((var_pop(b) + 1e-20) / (var_pop(a) + 1e-20)) / sqrt((var_pop(a) + 1e-20) / "
       f"(var_pop(x) + 1e-20)) AS hjorth_complexity FROM d2 GROUP BY 1, 2), "
       f"pc AS (SELECT ch, w, c, count(*) / sum(count(*)) OVER (PARTITION BY ch, w) AS pr FROM d1 "
       f"WHERE c IS NOT NULL GROUP BY 1, 2, 3), pe AS (SELECT ch, w, -sum(pr * ln(pr)) / ln(6.0) "
       f"AS pe_broad FROM pc GROUP BY 1, 2) SELECT w, "
       + ", ".join(f"{S.r6(f'median({n})')} AS {n}" for n in SPECTRAL)
       + " FROM sp JOIN hj USING (ch, w) JOIN pe USING (ch, w) GROUP BY w")
def spectral_features(spark, sf):
    """The markers that do not need a band-pass filter, median over channels."""
    return rounded(signal.window_features(signal_windows(spark, sf), [], FS), ["w"], SPECTRAL)


@query("nice_features")
def nice_features(spark, sf):
    return rounded(signal.window_features(signal_windows(spark, sf), [], FS), ["w"],
                   signal.FEATURES)


TAPS = "[" + ", ".join(repr(float(h)) for h in filters.resample_taps(2, 5)) + "]"


@query("resampled_signal", f"WITH {SIG}, hh AS (SELECT unnest({TAPS}::DOUBLE[]) AS h, "
       f"unnest(range(101)) AS q), len AS (SELECT max(t) + 1 AS n FROM bn), "
       f"o AS (SELECT unnest(range((n * 2 + 4) // 5)) AS m FROM len) "
       f"SELECT ch, m::BIGINT AS t, {S.r6('sum(x * h)')} AS x FROM o JOIN hh "
       f"ON (m * 5 + 50 - q) % 2 = 0 JOIN sg ON sg.t = (m * 5 + 50 - q) // 2 "
       f"AND m * 5 + 50 - q >= 0, len WHERE sg.t < len.n GROUP BY 1, 2")
def resampled_signal(spark, sf):
    """The whole series at 2/5 of its rate, filtered across segment borders."""
    seg = (signal.windows_of(regular_signal(spark, sf), ["ch"], 320, rest=True)
           .withColumnRenamed("w", "seg"))
    out = signal.resample_recording(seg, ["ch"], 2, 5, 320)
    return (out.select("ch", "seg", F.posexplode("samples").alias("place", "x"))
            .select("ch", (F.col("seg") * 128 + F.col("place")).alias("t"), r6("x").alias("x")))


@query("bipolar_window_zscore", f"WITH {SIG}, pr(pair, a, c) AS (VALUES (0, 'error', 'click'), "
       f"(1, 'view', 'signup'), (2, 'click', 'purchase')), d AS (SELECT pair, w, x.t, x.x - y.x AS x "
       f"FROM pr JOIN sw x ON x.ch = a JOIN sg y ON y.ch = c AND y.t = x.t) "
       f"SELECT pair::BIGINT AS pair, w, t % {LENGTH} AS t, {S.r6('(x - avg(x) OVER q) / (stddev_pop(x) OVER q + 1e-8)')} "
       f"AS z FROM d WINDOW q AS (PARTITION BY pair, w)")
def bipolar_window_zscore(spark, sf):
    """Channel differences of whole windows, standardised per window."""
    d = signal.bipolar_windows(signal_windows(spark, sf), ["w"], "ch", PAIRS)
    z = d.select(F.col("pair").cast("bigint").alias("pair"), "w",
                 F.posexplode(signal.row_zscored(F.col("samples"))).alias("t", "z"))
    return z.select("pair", "w", F.col("t").cast("bigint").alias("t"), r6("z").alias("z"))


@query("lempel_ziv")
def lempel_ziv(spark, sf):
    return signal_windows(spark, sf).select(
        "ch", "w", r6(signal.lempel_ziv(F.col("samples"))).alias("lziv"))


@query("band_passed")
def band_passed(spark, sf):
    return (signal_windows(spark, sf)
            .select("ch", "w", F.posexplode(signal.band_passed(F.col("samples"), 4, 8, FS))
                    .alias("t", "x"))
            .select("ch", "w", "t", r6("x").alias("x")))
