from collections import Counter

import corpus_pipeline as cp
from isochord.llm.mixing import planned
from isochord.session import written
from test_decontamination import brute as brute_hits
from test_lines_mix import brute_lines
from test_simhash import brute_near, jaccard

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_stage_equals_a_plain_one_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = written(stage(spark, docs, SF), name)
        assert out.columns == columns
        after = [tuple(r) for r in out.select("doc_id", "text").collect()]
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet")
                      .collect()}
            kept = {d for d, _ in after}
            clean = [d for d, _ in before if labels.get(d) == 1]
            junk = [d for d, _ in before if labels.get(d) == 0]
            assert all(d in kept for d in clean)
            assert sum(d in kept for d in junk) <= 0.5 * len(junk)
            assert set(after) <= set(before)
        elif name == "line_dedup":
            assert sorted(after, key=str) == sorted(
                ((d, t) for d, _, _, t in brute_lines(before, 10, 1)), key=str)
        elif name == "simhash_dedup":
            group = brute_near(before)
            assert sorted(d for d, _ in after) == sorted(set(group.values()))
            assert set(after) <= set(before)
            text = dict(before)
            gone = [d for d in group if group[d] != d]
            assert all(max(jaccard(text[d], text[e]) for e in group
                           if e != d and group[e] == group[d]) >= 0.6 for d in gone)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
                     .select("item_id", "text").collect()]
            clean = {d for d, _, hit, _ in brute_hits(before, items, 10) if not hit}
            assert {d for d, _ in after} == clean and len(after) == len(clean)
        else:
            want = {r.row.doc_id: r.copies for r in planned(docs).collect() if r.copies}
            assert Counter(d for d, _ in after) == want
        docs = out
    assert rows(cp.run(spark, SF)) == rows(docs)


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", None, None), (None, "", None, "a", 0), (2, "one two three", "en", "a", 13),
         (2, "one two three", "en", "a", 13), (3, "x " * 20000, "de", "b", 40000)],
        "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS row", "'k' AS kept_text", "2 AS copies")
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert written(stage(spark, docs.limit(0), SF), name).count() == 0
        docs = out
