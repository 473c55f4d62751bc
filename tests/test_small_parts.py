import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isochord.functions.vectors import softmax
from isochord.operators import calibrate, ordered, signal, stats, text


def test_softmax_skips_missing(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],)], "s array<double>")
    p = df.select(softmax(F.col("s")).alias("p")).first()["p"]
    e = np.exp([1.0, 3.0])
    assert p[1] is None and [p[0], p[2]] == pytest.approx(list(e / e.sum()))


def test_channel_tables(spark):
    pos = spark.createDataFrame([("A", 0.0, 0.0, 2.0), ("B", 2.0, 4.0, 0.0)],
                                "ch string, x double, y double, z double")
    mid = signal.pair_midpoints(pos, [("A", "B")]).first()
    assert (mid["x"], mid["y"], mid["z"]) == (1.0, 2.0, 1.0)
    vocab = spark.createDataFrame([("A", 7)], "ch string, index int")
    assert signal.channel_index(pos.filter("ch = 'A'"), vocab).first()["index"] == 7
    with pytest.raises(Exception, match="not in vocabulary"):
        signal.channel_index(pos, vocab).collect()


def test_bipolar_windows_and_row_scaling(spark):
    x = np.random.default_rng(0).normal(size=(3, 12))
    df = spark.createDataFrame(pd.DataFrame({"w": [0] * 3, "ch": list("ABC"),
                                             "samples": x.tolist()}))
    d = signal.bipolar_windows(df, ["w"], "ch", [("A", "C"), ("B", "Q")])
    row = d.select("pair", "samples", signal.row_zscored(F.col("samples")).alias("z"),
                   signal.row_iqr_scaled(F.col("samples"), 1.0).alias("q")).collect()
    v = x[0] - x[2]
    lo, hi = np.percentile(v, [25, 75])
    assert len(row) == 1 and row[0]["samples"] == pytest.approx(list(v))
    assert row[0]["z"] == pytest.approx(list((v - v.mean()) / (v.std() + 1e-8)))
    assert row[0]["q"] == pytest.approx(list(np.clip((v - lo) / (hi - lo + 1e-8), -1, 1)))


def test_lexicon_scores(spark):
    docs = spark.createDataFrame([(0, "Red sky, red sea"), (1, "")], "id int, text string")
    lex = spark.createDataFrame([("red", "colour"), ("sea", "water")], "word string, category string")
    got = {(r["id"], r["category"]): r["score"]
           for r in text.lexicon_scores(docs, "id", lex).collect()}
    assert got == pytest.approx({(0, "colour"): 0.5, (0, "water"): 0.25})


@pytest.mark.parametrize("bounds", [None, [], [0.7], [-1.0, 0.0, 0.7, 2.0]])
def test_quantiles_do_not_depend_on_bounds(spark, bounds):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=200), 1)
    x[:70] = 0.7
    keys = np.where(np.arange(200) < 150, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "x": x}))
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "x", {"q1": 0.25, "m": 0.5, "top": 1.0},
                                                bounds).collect()}
    for k in "ab":
        v = x[keys == k]
        assert [got[k][c] for c in ("q1", "m", "top")] == pytest.approx(
            list(np.quantile(v, [0.25, 0.5, 1.0])))


def test_family_statistics(spark):
    rng = np.random.default_rng(2)
    w, tail_min = 61, 10
    c = rng.random((3, w))
    rows = [("f", r, d, float(c[r, d])) for r in range(3) for d in range(w)]
    df = spark.createDataFrame(rows, "fam string, size_rank int, d long, score double")
    d = np.arange(w)
    tail = np.abs(np.where(d <= w // 2, d, d - w)) >= tail_min
    z = (c - c[:, tail].mean(1, keepdims=True)) / c[:, tail].std(1, ddof=1, keepdims=True)
    m = z.mean(0)
    got = calibrate.family_mean_z(df, ["size_rank"], ["fam"], w, tail_min).first()
    assert got["zbar"] == pytest.approx(m[0])
    assert got["p"] == pytest.approx((2 + (m[tail] >= m[0]).sum()) / (tail.sum() + 2))
    slopes = np.array([np.polyfit(np.arange(3), c[:, i], 1)[0] for i in range(w)])
    got = calibrate.slope_null(df, ["fam"], "size_rank", w, tail_min).first()
    assert got["slope"] == pytest.approx(slopes[0])
    assert got["p_slope"] == pytest.approx((1 + (slopes[tail] >= slopes[0]).sum())
                                           / (tail.sum() + 1))


def test_pairs_of_sizes(spark):
    dim = spark.createDataFrame([("f", 0, "s"), ("f", 1, "m"), ("f", 2, "l"), ("g", 0, "b"),
                                 ("g", 1, "h"), ("h", 0, "x")], "fam string, r int, m string")
    adj = {(r["m"], r["next"]) for r in stats.adjacent_pairs(dim, "fam", "r", "m", 3).collect()}
    assert adj == {("s", "m"), ("m", "l")}
    part = {r["m"]: r["partner"] for r in stats.intramodal_partner(dim, "fam", "r", "m").collect()}
    assert part == {"s": "m", "m": "l", "l": "m", "b": "h", "h": "b", "x": None}
