"""Moving between window grids: bins, pooling, interval overlap, frame ranges.

Windows tile time regularly, so each interval join has a closed form: a row computes the
windows it belongs to and is exploded into them. No range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP_SEC = 4
TR_SEC = 0.8
COMMON_SEC = 10


def vector_sum(vecs: Column) -> Column:
    """Element-wise sum of an array of equally long vectors."""
    first = F.transform(vecs[0], lambda x: x * F.lit(0.0))
    return F.aggregate(vecs, first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per key. Groups are the few windows, scans or subjects of one bin."""
    held = F.collect_list(F.col(vec).cast("array<double>"))
    return (df.groupBy(*keys).agg(held.alias("__v"))
            .select(*keys, F.transform(vector_sum(F.col("__v")),
                                       lambda x: x / F.size("__v")).alias(vec)))


def subject_mean(emb: DataFrame, keys: list[str]) -> DataFrame:
    """Mean embedding over subjects; ``keys`` leave the subject out."""
    return mean_vectors(emb, keys)


def common_bin(w: Column, win_sec: float, n_common: int,
               common_sec: float = COMMON_SEC) -> Column:
    """The bin holding the window's centre time, the last bin taking any overshoot."""
    return F.least(F.floor((w + 0.5) * win_sec / common_sec),
                   F.lit(n_common - 1)).cast("bigint")


def to_common(emb: DataFrame, keys: list[str], win_sec: float, n_common: int,
              common_sec: float = COMMON_SEC) -> DataFrame:
    """Mean of the windows in every bin; an empty bin is a zero vector."""
    binned = emb.withColumn("w", common_bin(F.col("w"), win_sec, n_common, common_sec))
    means = mean_vectors(binned, [*keys, "w"])
    bins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_common - 1).cast("bigint")))
    width = emb.groupBy(*keys).agg(F.max(F.size("vec")).alias("__dim"))
    full = width.select(*keys, "__dim", bins.alias("w"))
    zero = F.array_repeat(F.lit(0.0), F.col("__dim"))
    return full.join(means, [*keys, "w"], "left").select(
        *keys, "w", F.coalesce("vec", zero).alias("vec"))


def window_of_scan(tr: Column, win_sec: float, shift_sec: float) -> Column:
    """Window whose shifted span holds the scan's centre time (may be out of range).

    The division gives the candidate; comparing with its two edges settles centres that
    fall on an edge the same way as the half-open interval does.
    """
    centre = (tr + 0.5) * TR_SEC
    w = F.floor((centre - shift_sec) / win_sec)
    early = centre < w * win_sec + F.lit(float(shift_sec))
    late = centre >= (w + 1) * win_sec + F.lit(float(shift_sec))
    return (w - F.when(early, 1).otherwise(0) + F.when(late, 1).otherwise(0)).cast("bigint")


def window_pool(scans: DataFrame, keys: list[str], win_sec: float, shift_sec: float,
                n_windows: int, n_scans: int) -> DataFrame:
    """Mean of the scans centred in each shifted window.

    A window left empty (shifted past the end) takes the scan nearest its start.
    """
    w = window_of_scan(F.col("tr"), win_sec, shift_sec)
    inside = scans.withColumn("w", w).filter((F.col("w") >= 0) & (F.col("w") < n_windows))
    pooled = mean_vectors(inside, [*keys, "w"])
    all_w = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_windows - 1).cast("bigint")))
    nearest = F.least(F.lit(n_scans - 1).cast("bigint"),
                      F.bround((F.col("w") * win_sec + F.lit(float(shift_sec))) / F.lit(TR_SEC))
                      .cast("bigint"))
    empty = (scans.select(*keys).distinct().select(*keys, all_w.alias("w"))
             .join(pooled.select(*keys, "w"), [*keys, "w"], "left_anti")
             .withColumn("tr", nearest)
             .join(scans.select(*keys, F.col("tr").cast("bigint").alias("tr"),
                                F.col("vec").cast("array<double>").alias("vec")), [*keys, "tr"])
             .select(*keys, "w", "vec"))
    return pooled.unionByName(empty)


def clips_to_windows(clips: DataFrame, win_sec: int, n_windows: int) -> DataFrame:
    """Each clip once per window its [4c, 4c+4) span overlaps."""
    c = F.col("clip")
    first = F.floor(c * CLIP_SEC / win_sec)
    last = F.least(F.ceil((c + 1) * CLIP_SEC / F.lit(win_sec)) - 1, F.lit(n_windows - 1))
    return (clips.withColumn("__first", first.cast("bigint"))
            .withColumn("__last", last.cast("bigint")).filter("__first <= __last")
            .withColumn("w", F.explode(F.sequence("__first", "__last")))
            .drop("__first", "__last"))


def window_texts(clips: DataFrame, win_sec: int, n_windows: int) -> DataFrame:
    """Captions of each window joined in clip order, and how many there were."""
    held = F.array_sort(F.collect_list(F.struct("clip", "text")))
    return (clips_to_windows(clips, win_sec, n_windows).groupBy("w").agg(held.alias("__c"))
            .select("w", F.array_join(F.transform("__c", lambda c: c["text"]), " ").alias("text"),
                    F.size("__c").cast("bigint").alias("n_caps")))


def window_frames(clips: DataFrame, win_sec: float, n_windows: int) -> DataFrame:
    """Frame range [f_start, f_end) of every clip under every window, by time fraction."""
    spread = clips_to_windows(clips, win_sec, n_windows).filter("n_frames > 0")
    t0 = F.col("clip") * CLIP_SEC
    lo = F.greatest(F.col("w") * win_sec, t0) - t0
    hi = F.least((F.col("w") + 1) * win_sec, t0 + CLIP_SEC) - t0
    start = F.greatest(F.lit(0), F.floor(lo / CLIP_SEC * F.col("n_frames")))
    end = F.least(F.col("n_frames"), F.ceil(hi / CLIP_SEC * F.col("n_frames")))
    return (spread.withColumn("f_start", start.cast("bigint"))
            .withColumn("f_end", end.cast("bigint")).filter("f_end > f_start"))


def sampled_positions(n_frames: Column, n: int) -> Column:
    """n positions spread evenly over 0..n_frames-1, truncated; a single one is 0."""
    if n == 1:
        return F.array(F.lit(0).cast("bigint"))
    step = (n_frames - 1) / F.lit(float(n - 1))
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: (i * step).cast("bigint"))
    return F.concat(inner, F.array((n_frames - 1).cast("bigint")))


def scan_inventory(ids: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Count, range, contiguity and how many of 0..expected-1 are absent, per key."""
    d = ids.select(*keys, "id").distinct()
    inside = F.count_if((F.col("id") >= 0) & (F.col("id") < expected))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        (F.max("id") - F.min("id") + 1 == F.count(F.lit(1))).alias("contiguous"),
        (F.lit(expected) - inside).cast("bigint").alias("n_missing"))


def missing_scans(ids: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """The absent ids themselves."""
    want = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(expected - 1).cast("bigint")))
    return (ids.select(*keys).distinct().select(*keys, want.alias("id"))
            .join(ids.select(*keys, F.col("id").cast("bigint").alias("id")), [*keys, "id"],
                  "left_anti"))
