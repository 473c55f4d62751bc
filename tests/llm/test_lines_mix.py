import re

from isochord.llm.line_dedup import drop_repeated_lines
from isochord.llm.mixing import mixed, planned

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute_lines(docs, min_docs, min_chars):
    seen = {}
    for i, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    gone = {k for k, v in seen.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept),
                    text if len(kept) == len(lines) else "\n".join(kept)))
    return sorted(out, key=str)


LINES = [(1, "Foot\nbody one\n\nfoot "), (2, "\tFOOT\r\nbody two"), (3, None), (4, ""), (5, "\n"),
         (6, "É\nfoot"), (7, "é\nx"), (8, "É"), (9, "foot \nend"), (None, "foot"),
         (None, "foot"), (2, "foot\n\n"), (10, "\n".join(f"l{i}" for i in range(5000)) + "\nFoot")]


def test_lines_equal_brute_force(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").selectExpr(
        "*", "1 AS gone", "'a' AS row", "2 AS k1", "NULL AS lines")
    for least, chars in ((3, 1), (2, 1), (2, 0), (2, 2)):
        out = drop_repeated_lines(docs, min_docs=least, min_chars=chars)
        got = [(r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()]
        assert sorted(got, key=str) == brute_lines(LINES, least, chars)
    assert out.select("row.*").columns == docs.columns
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    rest, open_ = 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - 2 * sizes[s]) for s in order)
        open_ -= {s for s in order if target[s] >= 2 * sizes[s]}
        target = {s: min(t, 2.0 * sizes[s]) for s, t in target.items()}
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), "abcé"[i % 4] + "\U00010000" * (i % 2)) for i in range(400)]
    rows += [(400, None, "n"), (401, "", "z"), (402, "x y", None), (None, "x y z", None),
             (403, "one", "ﬁ"), (0, "again", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "7 AS size", "8 AS copies", "9 AS target")
    got = planned(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len((r.row.text or "").split())
        assert r.source_size == sizes[r.row.source]
        assert abs(r.target - want[r.row.source]) < 1e-6
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 2
    taken = sum(r["size"] * r.copies for r in got)
    assert abs(taken - sum(want.values())) < 0.1 * sum(want.values())
    assert sorted(map(str, got)) == sorted(map(str, planned(docs.repartition(7)).collect()))
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert planned(docs.limit(0)).count() == 0
