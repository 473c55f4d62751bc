import json
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isochord.functions import filters
from isochord.operators import regrid, signal, stats, text
from isochord.sources import arrays, captions, embeddings, sinks
from isochord.streaming import windows


# -- filters and signal features -------------------------------------------------------

def direct_resample(x, up, down):
    """Zero-stuff, convolve, keep every down-th sample."""
    taps, half = filters.resample_taps(up, down), 10 * max(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[half:half + len(wide)]
    return full[::down][:-(-len(x) * up // down)]


@pytest.mark.parametrize("up,down", [(16, 125), (2, 5), (32, 125), (1, 5), (3, 2)])
def test_resample(up, down):
    x = np.random.default_rng(0).normal(size=(2, 500))
    got = filters.resample(x, up, down)
    for row, want in zip(got, x):
        assert np.allclose(row, direct_resample(want, up, down))


def test_resample_keeps_a_slow_wave():
    t = np.arange(4000) / 1000
    y = filters.resample(np.sin(2 * np.pi * 5 * t)[None], 16, 125)[0]
    want = np.sin(2 * np.pi * 5 * np.arange(len(y)) / 128)
    assert np.abs(y - want)[40:-40].max() < 5e-3


def test_band_pass_gain_and_phase():
    fs, lo, hi, n = 128.0, 4.0, 8.0, 8192
    x = np.zeros((1, n))
    x[0, n // 2] = 1.0
    y = filters.zero_phase_band(x, lo, hi, fs)[0]
    f = np.fft.rfftfreq(n, 1 / fs)[1:-1]
    w, a, b = (np.tan(np.pi * v / fs) for v in (f, lo, hi))
    want = 1 / (1 + ((w * w - a * b) / (w * (b - a))) ** 8)
    assert np.allclose(np.abs(np.fft.rfft(y))[1:-1], want, atol=1e-6)
    assert np.allclose(y[n // 2 - 200:n // 2], y[n // 2 + 200:n // 2:-1], atol=1e-9)


def test_band_pass_removes_a_constant():
    assert np.abs(filters.zero_phase_band(np.full((1, 200), 3.0), 4, 8, 128.0)).max() < 1e-8


def test_welch_by_hand():
    x = np.random.default_rng(1).normal(size=600)
    f, p = filters.welch(x[None], 128.0, 256)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    segs = [x[s:s + 256] for s in (0, 128, 256)]
    want = np.mean([np.abs(np.fft.rfft((s - s.mean()) * win)) ** 2 for s in segs], axis=0) \
        / (128.0 * (win ** 2).sum())
    want[1:-1] *= 2
    assert np.allclose(p[0], want) and f[1] == 0.5


def plain_features(x):
    d1, d2 = np.diff(x), np.diff(np.diff(x))
    mob = math.sqrt(d1.var() / x.var())
    c = Counter(tuple(np.argsort(x[i:i + 3])) for i in range(len(x) - 2))
    p = np.array(list(c.values())) / (len(x) - 2)
    return mob, math.sqrt(d2.var() / d1.var()) / mob, -(p * np.log(p)).sum() / math.log(6)


def test_signal_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 320)).cumsum(axis=1)
    df = spark.createDataFrame(pd.DataFrame(
        {"ch": range(4), "w": [0] * 4, "samples": x.tolist()}))
    rows = {r["ch"]: r for r in signal.channel_features(df, 128.0).collect()}
    hj = {r["ch"]: r for r in signal.hjorth(df).collect()}
    pe = {r["ch"]: r["perm_entropy"] for r in signal.permutation_entropy(df).collect()}
    for ch in range(4):
        mob, com, ent = plain_features(x[ch])
        for r in (rows[ch], hj[ch]):
            assert r["hjorth_mobility"] == pytest.approx(mob)
            assert r["hjorth_complexity"] == pytest.approx(com)
        assert rows[ch]["pe_broad"] == pytest.approx(ent) and pe[ch] == pytest.approx(ent)
        f, p = filters.welch(x[ch][None], 128.0, 256)
        wide = (f >= 1) & (f <= 30)
        alpha = p[0][(f >= 8) & (f < 13)].sum()
        assert rows[ch]["rel_alpha"] == pytest.approx(alpha / p[0][wide].sum())
        assert rows[ch]["abs_alpha"] == pytest.approx(math.log(alpha))
        share = p[0][wide] / p[0][wide].sum()
        assert rows[ch]["spec_entropy"] == pytest.approx(
            -(share * np.log(share)).sum() / math.log(wide.sum()))
        cum = np.cumsum(share)
        assert rows[ch]["spec_edge90"] == f[wide][np.searchsorted(cum, 0.9)]
    med = signal.window_features(df, [], 128.0).first()
    assert med["abs_alpha"] == pytest.approx(np.median([rows[c]["abs_alpha"] for c in range(4)]))
    assert set(signal.FEATURES) <= set(med.asDict()) and len(signal.FEATURES) == 16


def test_recording_resampled_in_pieces_equals_whole(spark):
    x = np.random.default_rng(3).normal(size=4000)
    seg = spark.createDataFrame(pd.DataFrame(
        {"ch": ["a"] * 5, "seg": range(5), "samples": x.reshape(5, 800).tolist()}))
    rows = signal.resample_recording(seg.withColumn("seg", F.col("seg").cast("bigint")), ["ch"],
                                     4, 5, 800).orderBy("seg").collect()
    got = np.concatenate([r["samples"] for r in rows])
    assert np.allclose(got, filters.resample(x[None], 4, 5)[0])


@pytest.mark.parametrize("n", [4000, 4003, 4160, 4799])
def test_short_last_segment_is_resampled(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    flat = spark.createDataFrame(pd.DataFrame({"ch": "a", "t": np.arange(n), "x": x}))
    seg = signal.windows_of(flat, ["ch"], 800, rest=True).withColumnRenamed("w", "seg")
    rows = signal.resample_recording(seg, ["ch"], 2, 5, 800).orderBy("seg").collect()
    got = np.concatenate([r["samples"] for r in rows])
    want = filters.resample(x[None], 2, 5)[0]
    assert len(got) == -(-n * 2 // 5) and np.allclose(got, want)


def test_resampled_signal_has_the_whole_series(spark):
    import __spark_entry__ as entry
    from isochord.plans.content import regular_signal
    sf = "/root/testdata/sf0.01"
    n = {r["ch"]: r["n"] for r in regular_signal(spark, sf).groupBy("ch").agg(
        F.count("*").alias("n")).collect()}
    got = entry.queries()["resampled_signal"](spark, sf).groupBy("ch").count().collect()
    assert n and {r["ch"]: r["count"] for r in got} == {c: -(-k * 2 // 5) for c, k in n.items()}


def words_by_sets(text):
    """One more than the number of whole words, each the shortest string that has not occurred
    before its own last symbol; occurrences are looked up in the set of all earlier strings."""
    whole, begin = 0, 0
    for end in range(1, len(text) + 1):
        earlier = {text[a:b] for a in range(end) for b in range(a, end)}
        if text[begin:end] not in earlier:
            whole, begin = whole + 1, end
    return whole + 1


def test_lempel_ziv():
    # by hand: 0|001|10|100|1000|101, 0|00.., 0|1|01.. and 1|0|
    for text, words in (("0001101001000101", 6), ("0" * 12, 2), ("01" * 8, 3), ("10", 3)):
        assert words_by_sets(text) == words
        bits = np.array([int(c) for c in text], np.uint8).tobytes()
        assert signal._lempel_ziv(bits) == pytest.approx(words * np.log(len(text)) / len(text))
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 40, 41):
        for _ in range(20):
            text = "".join(rng.choice(["0", "1"], n))
            bits = np.array([int(c) for c in text], np.uint8).tobytes()
            assert signal._lempel_ziv(bits) == pytest.approx(words_by_sets(text) * np.log(n) / n)


def test_bipolar_and_scaling(spark):
    rng = np.random.default_rng(5)
    x = {c: rng.normal(size=9) for c in "ABC"}
    df = spark.createDataFrame([(c, t, float(v)) for c, xs in x.items() for t, v in enumerate(xs)],
                               "ch string, t int, x double")
    d = signal.bipolar(df, ["t"], "ch", [("A", "B"), ("B", "C"), ("A", "Z")])
    got = {(r["pair"], r["t"]): r["x"] for r in d.collect()}
    assert len(got) == 18
    assert got[(1, 4)] == pytest.approx(x["B"][4] - x["C"][4])
    z = {r["t"]: r["z"] for r in stats.iqr_scaled(d.filter("pair = 0"), ["pair"], "x", "z")
         .collect()}
    v = x["A"] - x["B"]
    lo, hi = np.percentile(v, [25, 75])
    assert [z[t] for t in range(9)] == pytest.approx(list((v - lo) / (hi - lo + 1e-8)))


# -- text ------------------------------------------------------------------------------

TEXTS = ["A man walks; the Man sees women in the dark room.", "she runs fast she hides",
         "", "Robots robots build a gadget gadget gadget, walks"]


def test_caption_attributes(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    hits = {r["id"]: r for r in text.caption_hits(df).collect()}
    for i, t in enumerate(TEXTS):
        low = " " + t.lower() + " "
        for name, words in text.LEXICONS.items():
            assert hits[i][name] == sum(low.count(w) for w in words)
    z = text.caption_attributes(df).orderBy("id").collect()
    v = np.array([hits[i]["person"] for i in range(4)], float)
    assert [r["person"] for r in z] == pytest.approx(list((v - v.mean()) / (v.std() + 1e-9)))


def test_tfidf(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {(r["id"], r["term"]): r["weight"]
           for r in text.tfidf(df, "id", "text", ["the", "in"], 6).collect()}
    tf = [Counter(w for w in re.findall(r"\w{2,}", t.lower()) if w not in ("the", "in"))
          for t in TEXTS]
    total = sum(tf, Counter())
    vocab = sorted(total, key=lambda w: (-total[w], w))[:6]
    idf = {w: math.log(5 / (1 + sum(w in d for d in tf))) + 1 for w in vocab}
    want = {}
    for i, d in enumerate(tf):
        raw = {w: d[w] * idf[w] for w in vocab if w in d}
        size = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(i, w): v / size for w, v in raw.items()})
    assert got == pytest.approx(want)


def test_mined_labels(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = [(r["word"], r["n"]) for r in text.mined_labels(df, "id", n_mined=4).collect()]
    assert got == [("gadget", 3), ("walks", 2), ("robots", 2), ("sees", 1)]
    kinds = Counter(r["kind"] for r in text.label_bank(df, "id").collect())
    assert (kinds["object"], kinds["scene"], kinds["action"]) == (80, 20, 12)


# -- grids -----------------------------------------------------------------------------

@pytest.mark.parametrize("win,n,per", [(5, 2160, 2), (6, 1800, 2), (8, 1350, 2), (10, 1080, 3),
                                       (4, 2700, 1)])
def test_captions_per_window(spark, win, n, per):
    clips = spark.range(2700).select(F.col("id").alias("clip"))
    got = regrid.clips_to_windows(clips, win, n).groupBy("w").count()
    row = got.agg(F.count("w"), F.min("count"), F.max("count")).first()
    assert row[0] == n and row[2] == per
    held = {r["w"]: r["count"] for r in got.filter("w < 30").collect()}
    for w in range(30):
        assert held[w] == sum(min(c * 4 + 4, (w + 1) * win) > max(c * 4, w * win)
                              for c in range(90))


def test_common_grid_and_empty_bins(spark):
    x = np.arange(14.0).reshape(7, 2)
    df = spark.createDataFrame(pd.DataFrame({"m": ["a"] * 7, "w": range(7), "vec": x.tolist()}))
    got = {r["w"]: r["vec"] for r in regrid.to_common(df, ["m"], 6, 5).collect()}
    bins = [min(int((w + 0.5) * 6 // 10), 4) for w in range(7)]
    for b in range(5):
        rows = [x[w] for w in range(7) if bins[w] == b]
        assert got[b] == pytest.approx(list(np.mean(rows, axis=0)) if rows else [0.0, 0.0])


@pytest.mark.parametrize("shift", [0.0, 4.0, 9.0])
def test_scan_pooling(spark, shift):
    n, win = 25, 4
    x = np.random.default_rng(6).normal(size=(n, 3))
    df = spark.createDataFrame(pd.DataFrame({"s": ["a"] * n, "tr": range(n), "vec": x.tolist()}))
    got = {r["w"]: r["vec"] for r in regrid.window_pool(df, ["s"], win, shift, 5, n).collect()}
    centre = (np.arange(n) + 0.5) * 0.8
    assert sorted(got) == list(range(5))
    for w in range(5):
        at = np.where((centre >= w * win + shift) & (centre < (w + 1) * win + shift))[0]
        if not at.size:
            at = [min(n - 1, int(round((w * win + shift) / 0.8)))]
        assert got[w] == pytest.approx(list(x[at].mean(0)))


def test_frame_ranges_and_sampling(spark):
    clips = spark.createDataFrame([(c, 33) for c in range(5)], "clip long, n_frames long")
    got = regrid.window_frames(clips, 5, 4).groupBy("w").agg(
        F.sum(F.col("f_end") - F.col("f_start")).alias("n")).orderBy("w")
    assert [r["n"] for r in got.collect()][0] == 33 + 9
    rows = got.select("n", regrid.sampled_positions(F.col("n"), 16).alias("p"),
                      regrid.sampled_positions(F.col("n"), 1).alias("one")).collect()
    for r in rows:
        assert r["p"] == np.linspace(0, r["n"] - 1, 16, dtype=int).tolist() and r["one"] == [0]


# -- sources, sinks, streams -----------------------------------------------------------

def test_numbered_files(spark, tmp_path):
    for i in (0, 1, 3, 9):
        np.save(tmp_path / f"{i}.npy", np.full((4, 6), float(i)))
    np.save(tmp_path / "notes.npy", np.zeros(3))
    folder = str(tmp_path)
    scans = {r["tr"]: r["vec"] for r in arrays.read_scans(spark, folder, 5).collect()}
    assert sorted(scans) == [0, 1, 3] and scans[3] == [3.0] * 24
    seg = arrays.read_segments(spark, folder, 5, 2, 3)
    assert seg.count() == 6 and seg.filter("seg = 1 AND ch = 1").first()["samples"] == [1.0] * 3
    full = arrays.complete_segments(seg, ["ch"], 5)
    assert full.filter("samples IS NULL").count() == 4
    ids = arrays.numbered_files(spark, folder).select(F.lit("s").alias("s"), "id")
    inv = regrid.scan_inventory(ids, ["s"], 5).first()
    assert (inv["n_ids"], inv["lo"], inv["hi"], inv["contiguous"], inv["n_missing"]) \
        == (4, 0, 9, False, 2)
    assert sorted(r["id"] for r in regrid.missing_scans(ids, ["s"], 5).collect()) == [2, 4]


def test_captions_are_ordered_by_clip_number(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"video": f"a/clip_{i}.mp4", "text": f"t{i}"} for i in (10, 2, 33)]))
    got = captions.read_captions(spark, str(path), 2).orderBy("clip").collect()
    assert [(r["clip"], r["text"]) for r in got] == [(0, "t2"), (1, "t10")]


def test_all_captions_are_read(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"video": f"clip_{i}.mp4", "text": f"t{i}"}
                                for i in range(3000, 0, -1)]))
    got = captions.read_captions(spark, str(path)).collect()
    assert sorted((r["clip"], r["text"]) for r in got) == [(i, f"t{i + 1}") for i in range(3000)]


def test_cells_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "out")
    want = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "m string, s int")
    assert sinks.pending(want, path, ["m", "s"]).count() == 3
    rows = [("a", 1, 0.5), ("b", 1, 0.7)]
    sinks.write_cells(spark.createDataFrame(rows, "m string, s int, v double"), path, ["m", "s"])
    assert [tuple(r) for r in sinks.pending(want, path, ["m", "s"]).collect()] == [("a", 2)]
    sinks.write_cells(spark.createDataFrame([("a", 1, 0.9)], "m string, s int, v double"), path,
                      ["m", "s"])
    assert {(r["m"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 0.9), ("b", 0.7)}


def test_embedding_sources(spark, tmp_path):
    path = str(tmp_path / "emb")
    spark.createDataFrame([("m", "g1", 0, [1.0, 2.0]), ("m", "g2", 0, [1.0, 2.0]),
                           ("n", "g2", 0, [1.0])],
                          "model string, grid string, w long, vec array<float>").write.parquet(path)
    emb = embeddings.read_embeddings(spark, path)
    assert {r["layer"] for r in emb.collect()} == {0}
    assert embeddings.read_embeddings(spark, path, model=["n"]).count() == 1
    used = {(r["model"], r["used_grid"]) for r in
            embeddings.with_fallback(emb, ["model"], "g1", "g2").collect()}
    assert used == {("m", "g1"), ("n", "g2")}
    assert embeddings.checked_width(emb, ["model"]).count() == 3
    with pytest.raises(Exception, match="differ in length"):
        embeddings.checked_width(emb, ["layer"]).collect()
    gone = embeddings.optional_read(spark, str(tmp_path / "none"), embeddings.EMBEDDING_SCHEMA)
    assert gone.count() == 0 and gone.schema == embeddings.EMBEDDING_SCHEMA
    starts = embeddings.window_starts(embeddings.grid_dim(spark))
    assert starts.count() == sum(g[2] for g in embeddings.GRIDS)
    assert starts.filter("start_s >= 10800").count() == 0


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"
    assert embeddings.with_retry(read, 4, 5.0, waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(OSError):
        embeddings.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 1.0, waits.append)


def test_stream_windows_equal_batch(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(20, 8))
    src = str(tmp_path / "in")
    df = spark.createDataFrame(pd.DataFrame({"s": ["a"] * 20, "seg": range(20),
                                             "samples": x.tolist()}))
    df = df.withColumn("seg", F.col("seg").cast("bigint"))
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    flat = x.ravel()
    for last in (None, 5):
        out = windows.segment_windows(stream, ["s"], 800, 8, 2000, last_window=last)
        got = {r["w"]: r["samples"] for r in windows.run_to_table(out, spark, "t").collect()}
        assert sorted(got) == list(range(8 if last is None else 6))
        for w in got:
            assert got[w] == pytest.approx(list(flat[w * 20:(w + 1) * 20]))
    out = windows.segment_windows(stream, ["s"], 800, 8, 2400)  # a part-window is left over
    got = sorted(r["w"] for r in windows.run_to_table(out, spark, "t").collect())
    assert got == list(range(6))
