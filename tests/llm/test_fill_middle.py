import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochord.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EDGE = ["", " ", "\t\n ", "a", " a", "a ", "é", "😀 ü b  日本語 ", "x <P> y", "x <S", "M> <",
        "<<P", "  \x0b\x0c\r", "\x1c\x85 a", "a\n\nb"]


def brute(i, text, seed=42, rate=50, share=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab é日😀 \n\t<PSM>") for _ in range(rng.randint(0, 60)))
            for _ in range(1500)]
    return EDGE * 12 + made + [" ".join(["wörd😀"] * 300_000)]


def test_equals_brute_force_and_is_restored(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fm.filled_middle(docs).withColumn("again", fm.restored(F.col("output"), F.col("form")))
    want, seen = dict(rows), set()
    for r in got.collect():
        assert tuple(r[1:6]) == brute(r.row.doc_id, want[r.row.doc_id]), r.row.doc_id
        assert r.again == want[r.row.doc_id]
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}


def test_rate_and_share_are_reached(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some words to cut' AS text")
    forms = [r.form for r in fm.filled_middle(docs, rate=90, spm_share=50).collect()]
    assert 0.87 < np.mean([f != "plain" for f in forms]) < 0.93
    assert 0.41 < np.mean([f == "psm" for f in forms]) < 0.49
    assert {r.form for r in fm.filled_middle(docs, rate=0).collect()} == {"plain"}


def test_index_converts_both_ways():
    text = "aé日😀 z" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    index = fm.ExceptionIndex(data)
    points = np.arange(len(text) + 1)
    want = np.array([len(text[:k].encode()) for k in points])
    assert index.to_bytes(points).tolist() == want.tolist()
    assert index.to_points(want).tolist() == points.tolist()
    plain = fm.ExceptionIndex(np.frombuffer(b"only ascii", np.uint8))
    assert len(plain.at_byte) == 0 and plain.to_bytes(np.array([4])).tolist() == [4]


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(None, None, "x"), (None, "a b", None), (7, "a b c", "y"), (7, "a b c", "y"), (8, "", "")],
        "doc_id long, text string, form string").selectExpr("*", "1 AS row", "2 AS made")
    got = fm.filled_middle(docs).collect()
    assert len(got) == 5
    for r in got:
        i = "" if r.row.doc_id is None else r.row.doc_id
        assert tuple(r[1:6]) == brute(i, r.row.text)
    assert got[0].row.form == "x" and got[2].output == got[3].output
    assert fm.filled_middle(docs.limit(0)).count() == 0


def test_markers_that_overlap_are_refused(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "'a' AS text")
    for markers in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            fm.filled_middle(docs, markers=markers)


def test_whole_table(spark):
    from isochord.llm.queries import QUERIES
    got = QUERIES["op11_fill_middle"](spark, "/root/testdata/sf0.001").collect()
    rows = {r.doc_id: r.text for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        n, form, p, m, out = brute(r.doc_id, rows[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()
