"""Groups too small or too flat for a statistic give NULL and let the others be."""

import pytest
from pyspark.sql import functions as F

from isochord.operators import calibrate as cal
from isochord.operators import stats


def curve(spark, rows):
    return spark.createDataFrame(rows, "key string, d long, score double")


def test_ancova_with_constant_x(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 0.0)]
    got = stats.ancova(spark.createDataFrame(rows, "f string, x double, y double"), "f", "x",
                       "y").first()
    assert got["n"] == 5 and got["slope_adj"] is None and got["p"] is None
    within = [(f, x, y) for f, x, y in [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 2.0, 4.0),
                                        ("b", 2.0, 1.0)]]
    got = stats.ancova(spark.createDataFrame(within, "f string, x double, y double"), "f", "x",
                       "y").first()
    assert got["slope_unadj"] == pytest.approx(0.0) and got["slope_adj"] is None


def test_ancova_with_no_degrees_of_freedom_or_a_perfect_fit(spark):
    three = [("a", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 2.5, 4.0), ("c", 3.5, 1.0)]
    got = stats.ancova(spark.createDataFrame(three, "f string, x double, y double"), "f", "x",
                       "y").first()
    assert got["slope_adj"] == pytest.approx(-3.0) and got["p"] is None
    exact = [(f, x, 2 * x) for f in "ab" for x in (1.0, 2.0, 3.0)]
    got = stats.ancova(spark.createDataFrame(exact, "f string, x double, y double"), "f", "x",
                       "y").first()
    assert got["slope_adj"] == pytest.approx(2.0)


def test_two_samples_with_one_empty(spark):
    rows = [("k", 1.0, True), ("k", 2.0, True), ("m", 1.0, True), ("m", 2.0, False)]
    df = spark.createDataFrame(rows, "key string, v double, near boolean")
    ks = {r["key"]: r["ks"] for r in stats.ks_stat(df, ["key"], "v", F.col("near")).collect()}
    assert ks == {"k": None, "m": 1.0}
    auc = {r["key"]: r["auc"] for r in stats.cles_auc(df, ["key"], "v", F.col("near")).collect()}
    assert auc == {"k": None, "m": 0.0}


def test_rank_correlation_of_two_rows(spark):
    rows = [("two", 1.0, 2.0), ("two", 2.0, 5.0), ("one", 1.0, 1.0),
            *[("many", float(i), float(i * i % 7)) for i in range(9)]]
    got = {r["k"]: r for r in stats.spearman(spark.createDataFrame(
        rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["two"]["rho"] == 1.0 and got["one"]["rho"] is None
    assert got["many"]["p"] is not None


def test_recordings_without_far_rotations(spark):
    rows = [("short", d, 0.1 * d) for d in range(4)] + [("flat", d, 0.5) for d in range(4)]
    for tail in (10, 2, 0):
        got = {r["key"]: r for r in cal.tail_stats(curve(spark, rows), ["key"], 4, tail).collect()}
        assert set(got) == {"short", "flat"} and got["flat"]["z_tail"] is None
        assert got["short"]["obs"] == 0.0
    assert cal.tail_stats(curve(spark, rows), ["key"], 4, 10).first()["p_tail"] == 1.0


def test_families_with_flat_curves(spark):
    rows = [(f, m, d, 0.5 if f == "flat" else 0.1 * ((d * (m + 2)) % 5))
            for f in ("flat", "good") for m in range(3) for d in range(12)]
    df = spark.createDataFrame(rows, "family string, size int, d long, score double")
    got = {r["family"]: r for r in cal.family_mean_z(df, ["size"], ["family"], 12, 3).collect()}
    assert got["flat"]["zbar"] is None and got["flat"]["p"] is None
    assert got["good"]["zbar"] is not None
    slope = {r["family"]: r for r in cal.slope_null(df, ["family"], "size", 12, 3).collect()}
    assert slope["flat"]["slope"] == 0.0 and slope["good"]["p_slope"] is not None


def test_one_rotation(spark):
    got = cal.calibrate_cyclic(curve(spark, [("k", 0, 0.3)]), ["key"], 1).first()
    assert got["obs"] == 0.3 and got["null_mean"] is None and got["p"] == 1.0
