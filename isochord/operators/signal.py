"""Signal windows and their features.

One row holds one channel's samples of one window, so features of different channels are
computed anywhere in the cluster; the median over channels is a Spark aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.functions.filters import resample, welch, zero_phase_band

# Frequency bands in Hz and the feature names.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)}
SPECTRUM = (1.0, 30.0)
FEATURES = ["abs_delta", "rel_delta", "abs_theta", "rel_theta", "abs_alpha", "rel_alpha",
            "abs_beta", "rel_beta", "spec_entropy", "median_freq", "spec_edge90", "pe_broad",
            "pe_theta", "pe_alpha", "hjorth_mobility", "hjorth_complexity"]

# Channel pairs of the bipolar montage (anode, cathode).
BIPOLAR_PAIRS = [
    ("Fp1", "F7"), ("F7", "T7"), ("T7", "P7"), ("P7", "O1"),
    ("Fp2", "F8"), ("F8", "T8"), ("T8", "P8"), ("P8", "O2"),
    ("T7", "C3"), ("C3", "Cz"), ("Cz", "C4"), ("C4", "T8"),
    ("Fp1", "F3"), ("F3", "C3"), ("C3", "P3"), ("P3", "O1"),
    ("Fp2", "F4"), ("F4", "C4"), ("C4", "P4"), ("P4", "O2"),
    ("TP9", "T7"), ("T8", "TP10"),
]


# -- windows -------------------------------------------------------------------------

def windows_of(samples: DataFrame, keys: list[str], length: int, t: str = "t",
               x: str = "x", rest: bool = False) -> DataFrame:
    """(keys, w, samples) with ``length`` samples each; an incomplete window is dropped, or with
    ``rest`` kept as far as it has all samples from its start on, as a recording's end does."""
    held = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x"))))
    return (samples.groupBy(*keys, F.floor(F.col(t) / length).cast("bigint").alias("w"))
            .agg(held.alias("__s"), F.count(F.lit(1)).alias("__n"), F.max(t).alias("__last"))
            .filter(F.col("__n") == (F.col("__last") - F.col("w") * length + 1 if rest
                                     else F.lit(length)))
            .select(*keys, "w", F.transform("__s", lambda s: s["x"]).alias("samples")))


def bipolar(samples: DataFrame, keys: list[str], channel: str, pairs: list[tuple[str, str]],
            x: str = "x") -> DataFrame:
    """Anode minus cathode for every pair, in one pass.

    Each sample is sent to the pairs it takes part in with its sign, and the two meet in
    one aggregation; a pair with a channel missing yields no row.
    """
    roles = [(i, a, c) for i, (a, c) in enumerate(pairs)]
    table = F.map_from_arrays(
        F.array(*[F.lit(ch) for ch in sorted({c for p in pairs for c in p})]),
        F.array(*[F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(s).alias("sign"))
                            for i, a, c in roles for s, name in ((1.0, a), (-1.0, c))
                            if name == ch])
                  for ch in sorted({c for p in pairs for c in p})]))
    return (samples.withColumn("__r", F.explode(F.element_at(table, F.col(channel))))
            .groupBy(*keys, F.col("__r.pair").alias("pair"))
            .agg(F.sum(F.col("__r.sign") * F.col(x)).alias(x), F.count(F.lit(1)).alias("__n"))
            .filter("__n = 2").drop("__n"))


def bipolar_windows(windows: DataFrame, keys: list[str], channel: str,
                    pairs: list[tuple[str, str]]) -> DataFrame:
    """As ``bipolar`` for rows that hold a whole window of samples."""
    ends = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(name).alias("ch"), F.lit(plus).alias("plus"))
                     for i, (a, c) in enumerate(pairs) for plus, name in ((True, a), (False, c))])
    mine = F.filter(ends, lambda e: e["ch"] == F.col(channel))
    sent = windows.select(*keys, "samples", F.explode(mine).alias("e"))
    first = F.max(F.when(F.col("e.plus"), F.col("samples")))
    second = F.max(F.when(~F.col("e.plus"), F.col("samples")))
    met = (sent.groupBy(*keys, F.col("e.pair").alias("pair"))
           .agg(first.alias("a"), second.alias("c")).filter("a IS NOT NULL AND c IS NOT NULL"))
    return met.select(*keys, "pair", F.zip_with("a", "c", lambda x, y: x - y).alias("samples"))


def row_zscored(samples: Column, eps: float = 1e-8) -> Column:
    """Each row's signal standardised by its own population moments."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, lambda x: (x - x.mean(-1, keepdims=True))
                          / (x.std(-1, keepdims=True) + eps))

    return run(samples)


def row_iqr_scaled(samples: Column, limit: float = 20.0) -> Column:
    """Each row's signal scaled by its own quartiles and clipped."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        def scale(x):
            lo, hi = np.percentile(x, [25, 75], axis=-1, keepdims=True)
            return np.clip((x - lo) / (hi - lo + 1e-8), -limit, limit)
        return _by_length(s, scale)

    return run(samples)


def pair_midpoints(positions: DataFrame, pairs: list[tuple[str, str]], channel: str = "ch",
                   axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Midpoint of the two electrodes of every pair."""
    ends = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(name).alias("ch"))
                     for i, p in enumerate(pairs) for name in p])
    mine = F.filter(ends, lambda e: e["ch"] == F.col(channel))
    return (positions.select(*axes, F.explode(mine).alias("e"))
            .groupBy(F.col("e.pair").alias("pair")).agg(*[F.avg(a).alias(a) for a in axes]))


def channel_index(channels: DataFrame, vocabulary: DataFrame, channel: str = "ch",
                  index: str = "index") -> DataFrame:
    """Channels with their vocabulary index; one that has none is an error at run time."""
    missing = F.raise_error(F.concat(F.lit("channel not in vocabulary: "), F.col(channel)))
    return channels.join(vocabulary, channel, "left").withColumn(
        index, F.coalesce(F.col(index), missing.cast("int")))


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s])


def _by_length(s: pd.Series, fn) -> pd.Series:
    """Applies a batch function to signals of equal length together."""
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    lengths = s.map(len)
    for n in lengths.unique():
        at = lengths.index[lengths == n]
        done = fn(_stack(s.loc[at]))
        for i, row in zip(at, done):
            out.at[i] = row
    return out


def resampled(samples: Column, up: int, down: int) -> Column:
    """Each row's signal at up/down times its rate."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, lambda x: resample(x, up, down))

    return run(samples)


def resample_recording(segments: DataFrame, keys: list[str], up: int, down: int,
                       length: int) -> DataFrame:
    """(keys, seg, samples) of a whole recording at the new rate, as if filtered in one go.

    Each segment of ``length`` samples receives the ends of its two neighbours, as far as the
    filter reaches, so no task ever holds a recording. ``length * up`` must be a multiple
    of ``down`` so that segments start on an output sample. The last segment may be shorter.
    """
    if length * up % down:
        raise ValueError("segments must start on an output sample")
    halo = down * -(-(10 * max(up, down) // up + 1) // down)
    if halo > length:
        raise ValueError("segment shorter than the filter reach")
    part = F.struct
    pieces = F.array(
        part(F.col("seg").alias("seg"), F.lit(0).alias("side"), F.col("samples").alias("s")),
        part((F.col("seg") + 1).alias("seg"), F.lit(-1).alias("side"),
             F.slice("samples", length - halo + 1, F.lit(halo)).alias("s")),
        part((F.col("seg") - 1).alias("seg"), F.lit(1).alias("side"),
             F.slice("samples", 1, F.lit(halo)).alias("s")))
    zeros = F.array_repeat(F.lit(0.0), halo)
    at = {side: F.max(F.when(F.col("p.side") == side, F.col("p.s"))) for side in (-1, 0, 1)}
    joined = (segments.select(*keys, F.explode(pieces).alias("p"))
              .groupBy(*keys, F.col("p.seg").alias("seg"))
              .agg(at[-1].alias("before"), at[0].alias("own"), at[1].alias("after"))
              .filter("own IS NOT NULL")
              .select(*keys, "seg", F.size("own").alias("__n"),
                      F.concat(F.coalesce("before", zeros), "own",
                               F.coalesce("after", zeros)).alias("samples")))
    skip = halo * up // down
    keep = F.ceil(F.col("__n") * up / down).cast("int")
    return joined.select(*keys, "seg", F.slice(resampled(F.col("samples"), up, down),
                                               F.lit(skip + 1), keep).alias("samples"))


def band_passed(samples: Column, lo: float, hi: float, fs: float) -> Column:
    """Zero-phase fourth-order Butterworth band-pass of each row's signal."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, lambda x: zero_phase_band(x, lo, hi, fs))

    return run(samples)


# -- features ------------------------------------------------------------------------

def _perm_entropy(x: np.ndarray) -> np.ndarray:
    """Normalised entropy of ordinal patterns of three consecutive samples, for all rows at once.

    Three comparisons name the pattern, so equal neighbours rank in time order; one histogram
    holds the patterns of every row.
    """
    first, second, third = x[:, :-2], x[:, 1:-1], x[:, 2:]
    rows, n = first.shape
    if n <= 1:
        return np.full(len(x), np.nan)
    pattern = (first > second) + 2 * (first > third) + 4 * (second > third)
    seen = np.bincount((pattern + 8 * np.arange(rows)[:, None]).ravel(), minlength=8 * rows)
    share = seen.reshape(rows, 8) / n
    return -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1) / np.log(6.0)


def _features(x: np.ndarray, fs: float) -> pd.DataFrame:
    """The sixteen scalars of each row of equally long signals."""
    f, power = welch(x, fs, int(min(x.shape[1], fs * 2)))
    wide = (f >= SPECTRUM[0]) & (f <= SPECTRUM[1])
    p, fb = power[:, wide], f[wide]
    total = p.sum(1) + 1e-20
    out = {}
    for name, (lo, hi) in BANDS.items():
        band = power[:, (f >= lo) & (f < hi)].sum(1)
        out[f"abs_{name}"] = np.log(band + 1e-20)
        out[f"rel_{name}"] = band / total
    share = p / total[:, None]
    out["spec_entropy"] = -(share * np.log(share + 1e-20)).sum(1) / np.log(wide.sum())
    cum = np.cumsum(p, axis=1) / total[:, None]
    for name, q in (("median_freq", 0.5), ("spec_edge90", 0.9)):
        out[name] = fb[np.minimum((cum < q).sum(1), len(fb) - 1)]
    out["pe_broad"] = _perm_entropy(x)
    for name in ("theta", "alpha"):
        out[f"pe_{name}"] = _perm_entropy(zero_phase_band(x, *BANDS[name], fs))
    d1 = np.diff(x, axis=1)
    v0, v1, v2 = (v.var(axis=1) + 1e-20 for v in (x, d1, np.diff(d1, axis=1)))
    mobility = np.sqrt(v1 / v0)
    out["hjorth_mobility"], out["hjorth_complexity"] = mobility, np.sqrt(v2 / v1) / mobility
    return pd.DataFrame(out)[FEATURES]


def channel_features(windows: DataFrame, fs: float) -> DataFrame:
    """The scalars of every row of ``samples``, one column each."""
    fields = T.StructType([T.StructField(n, T.DoubleType()) for n in FEATURES])

    @F.pandas_udf(fields)
    def run(s: pd.Series) -> pd.DataFrame:
        parts = []
        lengths = s.map(len)
        for n in lengths.unique():
            at = lengths.index[lengths == n]
            parts.append(_features(_stack(s.loc[at]), fs).set_index(at))
        return pd.concat(parts).loc[s.index]

    rest = [c for c in windows.columns if c != "samples"]
    return windows.withColumn("__f", run("samples")).select(*rest, "__f.*")


def window_features(windows: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Median over channels of every scalar, per window."""
    return (channel_features(windows, fs).groupBy(*keys, "w")
            .agg(*[F.median(n).alias(n) for n in FEATURES]))


def hjorth(windows: DataFrame) -> DataFrame:
    """Mobility and complexity without leaving the JVM."""
    def diff(a):
        n = F.size(a)
        return F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1),
                          lambda x, y: x - y)

    def variance(a):
        n = F.size(a).cast("double")
        zero = F.lit(0.0)
        mean = F.aggregate(a, zero, lambda s, x: s + x) / n
        return F.aggregate(a, zero, lambda s, x: s + (x - mean) * (x - mean)) / n + F.lit(1e-20)

    rest = [c for c in windows.columns if c != "samples"]
    d = (windows.withColumn("__d1", diff(F.col("samples")))
         .withColumn("__d2", diff(F.col("__d1")))
         .select(*rest, variance(F.col("samples")).alias("__v0"),
                 variance(F.col("__d1")).alias("__v1"), variance(F.col("__d2")).alias("__v2")))
    mobility = F.sqrt(F.col("__v1") / F.col("__v0"))
    return d.select(*rest, mobility.alias("hjorth_mobility"),
                    (F.sqrt(F.col("__v2") / F.col("__v1")) / mobility)
                    .alias("hjorth_complexity"))


def permutation_entropy(windows: DataFrame) -> DataFrame:
    """Ordinal-pattern entropy in the JVM; equal neighbours rank in time order."""
    a = F.col("samples")
    n = F.size(a) - 2
    pattern = F.transform(F.sequence(F.lit(1), n), lambda i: (
        F.when(F.get(a, i - 1) > F.get(a, i), 1).otherwise(0)
        + F.when(F.get(a, i - 1) > F.get(a, i + 1), 2).otherwise(0)
        + F.when(F.get(a, i) > F.get(a, i + 1), 4).otherwise(0)))
    rest = [c for c in windows.columns if c != "samples"]
    d = windows.select(*rest, pattern.alias("__c"))

    def part(code):
        p = F.size(F.filter("__c", lambda c: c == code)) / F.size("__c")
        return F.when(p > 0, -p * F.log(p)).otherwise(0.0)

    plogp = [part(code) for code in range(8)]
    return d.select(*rest, (sum(plogp[1:], plogp[0]) / F.log(F.lit(6.0))).alias("perm_entropy"))


def spectral_edge(spectrum: DataFrame, keys: list[str], q: float) -> DataFrame:
    """First frequency whose cumulative power reaches ``q``, the last one at most.

    ``spectrum`` has (keys, freq, power); the bins of one spectrum are few.
    """
    w = Window.partitionBy(*keys)
    upto = w.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)
    d = (spectrum.withColumn("__cum", F.sum("power").over(upto))
         .withColumn("__all", F.sum("power").over(w) + F.lit(1e-20)))
    reached = F.min(F.when(F.col("__cum") / F.col("__all") >= q, F.col("freq")))
    return d.groupBy(*keys).agg(F.coalesce(reached, F.max("freq")).alias("edge"))


def _lempel_ziv(bits: bytes) -> float:
    """Normalised Lempel-Ziv complexity of a 0/1 string, by growing unseen words."""
    n, start, words = len(bits), 0, 0
    while start < n:
        size = 1
        while start + size <= n and bits.find(bits[start:start + size], 0,
                                              start + size - 1) >= 0:
            size += 1
        words += 1
        start += size
    words += start == n  # a last word that ends with the string counts once more
    return words * np.log(n) / n if n > 1 else 0.0


def lempel_ziv(samples: Column) -> Column:
    """Complexity of the signal cut at its median."""

    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            x = np.asarray(v, dtype=np.float64)
            return _lempel_ziv((x > np.median(x)).astype(np.uint8).tobytes())
        return s.map(one).astype("float64")

    return run(samples)
