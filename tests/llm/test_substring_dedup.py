import random
from collections import Counter

import numpy as np
import pytest

from isochord.llm.substring_dedup import drop_repeated_strings, tied_windows


def brute(docs, length):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(docs, data):
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = True
        gone[-1] = False
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((doc_id, len(d), edge.tolist(), bytes(d[i] for i in range(len(d))
                                                         if not gone[i])))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
                        for _ in range(n))
    passage, line = prose(90), prose(14)
    docs = [(i, prose(rng.randint(1, 150))) for i in range(60)]
    docs += [(100 + i, prose(30) + passage + prose(30)) for i in range(12)]
    docs += [(200 + i, prose(20) + line + prose(20)) for i in range(40)]
    docs += [(300, None), (301, ""), (302, "x" * 199), (303, "x" * 200), (304, "x" * 201),
             (305, "ab" * 150), (306, passage[50:220]), (307, docs[0][1] + "!"), (308, docs[3][1]),
             (3, docs[3][1]), (None, docs[4][1] + docs[4][1]), (309, prose(3000))]
    edit = list(docs[61][1])
    for i in range(40, len(edit), 230):
        edit[i] = "Q"
    return docs + [(310, "".join(edit))]


@pytest.mark.parametrize("length,token,crowd,parts", [(200, 50, 2048, 4), (200, 50, 3, 7),
                                                      (60, 20, 2048, 3), (61, 25, 2, 3),
                                                      (200, 50, 15, 3)])
def test_equals_brute_force(spark, length, token, crowd, parts):
    docs = corpus()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
            "*", "1 AS k1", "'x' AS spans", "NULL AS asked")
        got = drop_repeated_strings(frame, length=length, token=token, crowd=crowd).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(((r.id, r.n_bytes, list(r.spans), bytes(r.kept)) for r in got),
                  key=str) == brute(docs, length)


def test_empty_table_and_string_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert drop_repeated_strings(none).count() == 0
    docs = spark.createDataFrame([("a", "y" * 300), ("b", "y" * 250 + "z"), (None, "short")],
                                 "doc_id string, text string")
    got = {r.id: list(r.spans) for r in drop_repeated_strings(docs).collect()}
    assert got == {"a": [0, 300], "b": [0, 250], None: []}


def test_multikey_sort_of_windows():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(3900)
    group = starts % 3
    for length in (9, 16, 13):
        seen = Counter((int(g), data[s:s + length].tobytes()) for s, g in zip(starts, group))
        want = [seen[int(g), data[s:s + length].tobytes()] > 1 for s, g in zip(starts, group)]
        assert tied_windows(data, starts, group, length).tolist() == want
