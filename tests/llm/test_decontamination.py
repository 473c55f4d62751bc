import re

import pytest

from isochord.llm.decontamination import clean, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            iw = words(item_text)
            n = min(window, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == iw[a:a + n]:
                        hit |= set(range(p, p + n))
                        found |= {item} - {None}
        out.append((doc_id, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


ITEMS = [(1, "a b c d e f g h i j k l m"), (2, "x y z"), (3, None), (4, ""), (5, "!!"), (6, "É è"),
         (7, "r r r r r r r r r r r r"), (10, "A B C D E F G H I J"), (None, "only null item here"),
         (2, "second row of two"), (8, "x y z")]
DOCS = [(1, "a b c d e f g h i j"), (2, "A, b-c d e f g h i j k l m n"), (3, None), (4, ""),
        (5, "x y z x Y z"), (6, "É è é è"), (7, "r " * 25), (8, "a b c d e f g h i"), (9, "xyz"),
        (10, "only null item here"), (None, "second row of two x y z"), (8, "x y z"),
        (11, "q " * 3000 + "x y z " + "q " * 3000), (12, "x y"), (12, "z")]


@pytest.mark.parametrize("window,block", [(10, 200_000), (3, 4), (10, 1)])
def test_equals_brute_force_in_one_block_or_many(spark, window, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr(
        "*", "1 AS row", "NULL AS runs", "'q' AS items")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs, items, window=window, block=block).selectExpr(
        "row.doc_id", "n_words", "n_hit", "items", "runs").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(
        DOCS, ITEMS, window)
    assert all(sum(r.runs[1::2]) - sum(r.runs[::2]) == r.n_hit for r in got)
    if block == 200_000:
        kept = clean(docs, items, window=window)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r[2] == 0 for r in brute(DOCS, ITEMS, window))


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, items).filter("n_hit > 0").count() == 0
    assert contamination(docs.limit(0), items).count() == 0
