import zlib

import numpy as np

from isochord.llm import quality
from isochord.llm.queries import QUERIES
from isochord.llm.rows import flat_utf8
import pyarrow as pa

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n1, n0 = label.sum(), (1 - label).sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    got = QUERIES["op4_quality"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    want = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.held_out.tolist() == want
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert auc(both.score.to_numpy(), both.quality.to_numpy()) > 0.95
    assert ((both.quality == 1) & (both.predicted == 0)).sum() == 0


def test_pair_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    f = quality.features(*flat_utf8(pa.array(["a b c a", "", "Shouting!! TWICE\n\nx"])))
    for i, z in enumerate(m.logits(f)):
        at = slice(f.start[i], f.start[i + 1])
        idx, x = f.index[at], f.value[at].astype(float)
        pairs = sum(m.vector[idx[a]] @ m.vector[idx[b]] * x[a] * x[b]
                    for a in range(len(idx)) for b in range(a))
        assert abs(z - (0.3 + m.weight[idx] @ x + pairs)) < 1e-4


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame(
        [(1, "some plain text"), (2, None), (3, ""), (None, "no id"), (1, "some plain text"),
         (4, "w " * 60000), (5, "!!! ### $$$")], "doc_id long, text string").selectExpr(
        "*", "1 AS score", "'a' AS row", "NULL AS quality")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, 0, None), (None, 1, 1), (3, None, 0),
                                    (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.row.doc_id == 1}) == 1
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.scored(docs, labels.limit(0)).count() == 7


def test_label_columns_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = quality.scored(docs, labels).selectExpr("row.doc_id", "score").toPandas()
    odd = docs.selectExpr("doc_id", "text", "'xx' AS lang", "NULL AS source", "7 AS n_chars")
    b = quality.scored(odd, labels).selectExpr("row.doc_id", "score").toPandas()
    assert (a.sort_values("doc_id").score.values == b.sort_values("doc_id").score.values).all()
