import sys

import pytest

import __spark_entry__ as entry
from check_queries import connect, differs

SF = "/root/testdata/sf0.001"
SAMPLE = ["mknn_all_shifts_layer_max", "mknn_cyclic_null", "cross_family_mean", "cka_shifts_sample",
          "window_pool", "tfidf", "benjamini_hochberg", "bipolar_iqr", "stream_tumbling"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differs(got, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_missing_optional_packages_leave_the_rest(monkeypatch):
    """What the training-corpus part needs and does not find must not take the rest with it."""
    for name in [m for m in sys.modules if m.startswith("isochord.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("public_tokenizers", "tokenizers", "xxhash"):
        monkeypatch.setitem(sys.modules, name, None)
    found = entry.queries()
    assert "knn_topk" in found and not any(q.startswith("op") or q == "pipeline" for q in found)
    assert set(entry.oracle_sql()) <= set(found)
