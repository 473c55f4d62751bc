import random
import re

import numpy as np
import pytest
import xxhash

from isochord.llm import simhash
from isochord.llm.components import components


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = ([" ".join(words[i:i + 4]) for i in range(len(words) - 3)]
                if len(words) >= 4 else [" ".join(words)])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                at[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, prints[i], least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.fixture
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    long = " ".join(f"w{i % 977}" for i in range(30000))
    extra = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One two\tthree"),
             (1005, "one  two three"), (1006, base[0][1]), (1007, base[0][1] + " more words"),
             (1008, long), (1009, long + " end"), (1010, "É è x\x0by Z"), (1006, base[0][1])]
    return base + extra


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_brute_force(spark, docs):
    got = simhash.simhash_groups(frame(spark, docs)).collect()
    got = sorted((r.id, r.fingerprint & (2**64 - 1), r.component_id) for r in got)
    assert got == sorted(brute_groups(docs))


def test_one_of_each_group_stays(spark, docs):
    rows = frame(spark, docs).selectExpr("*", "'x' AS row", "1 AS fp", "NULL AS grp")
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted({c for _, _, c in brute_groups(docs)})


def test_null_ids_and_empty_table(spark):
    rows = frame(spark, [(None, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v")])
    assert simhash.simhash_groups(rows).filter("component_id IS NULL").count() == 3
    assert simhash.one_of_each(rows).count() == 2
    none = frame(spark, [])
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.one_of_each(none).count() == 0


def test_tiles_find_every_pair_and_skip_far_counts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (3000, 4)).astype(np.uint64))
    b = a ^ np.bitwise_xor.reduce(flips, axis=1)
    got = {(int(p), int(q)) for x, y in simhash.close_pairs(a, b, 4, False) for p, q in zip(x, y)}
    want = set()
    for i in range(0, 3000, 100):
        x = np.bitwise_count(a[i:i + 100, None] ^ b[None]) <= 4
        want |= {(int(p) + i, int(q)) for p, q in zip(*np.nonzero(x))}
    assert got == want and len(want) >= 3000
    both = np.concatenate((a, b))
    same = {frozenset((int(p), int(q))) for x, y in simhash.close_pairs(both, both, 4, True)
            for p, q in zip(x, y) if p != q}
    assert len(same) == len({(p, q + 3000) for p, q in want} | {
        (i, j) for i in range(6000) for j in () if i < j})


def test_many_blocks_of_one_count(spark):
    values = [1 << i | 1 << j for i in range(60) for j in range(i)]
    frame_ = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.close_links(frame_, 2, block=100)
    found = components(links)
    assert found.select("component").distinct().count() == 1
    assert found.count() == len(values)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 900)]
    edges += [(1000, 1001 + i) for i in range(300)] + [(None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(201)} | {500: 500, 501: 500} | {1000 + i: 1000 for i in range(301)}
    assert got == want


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(
        {c: c + 32 for c in range(65, 91)}))


def shingle_set(text, width=5):
    w = words_of(text)
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_near(rows, radius=48):
    """{id: smallest id of its group}, all pairs compared bit by bit."""
    data = [(t or "").encode() for _, t in rows]
    off = np.cumsum([0, *map(len, data)])
    prints = simhash.wide_fingerprints(np.frombuffer(b"".join(data), np.uint8), off, 5, 4, 42)
    ids, group = [i for i, _ in rows], {i: i for i, _ in rows}
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if sum(int(x).bit_count() for x in prints[i] ^ prints[j]) <= radius]
    moved = True
    while moved:
        moved = False
        for i, j in near:
            least = min(group[ids[i]], group[ids[j]])
            for x in (ids[i], ids[j]):
                moved |= group[x] != least
                group[x] = least
    return group


def test_wide_fingerprints_have_the_majority_of_each_bit():
    texts = ["", "One two three", "a b c d e", "a b c d e f g A B C D E", "x " * 40, "é日 ü"]
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    got = simhash.wide_fingerprints(flat, off, 5, 4, 42)
    assert not got[0].any() and got[1:].any(axis=1).all()
    for i in range(1, len(texts)):
        one = simhash.wide_fingerprints(np.frombuffer(data[i].lower(), np.uint8),
                                   np.array([0, len(data[i])]), 5, 4, 42)
        assert (one[0] == got[i]).all()
    # a text of one shingle has that shingle's bits, whatever the repeats
    twice = simhash.wide_fingerprints(np.frombuffer(b"x x x x x x x x x", np.uint8), np.array([0, 17]),
                                 5, 4, 42)
    assert (twice[0] == got[4]).all()


def planted(seed, n, share):
    """Pairs (text, copy) with single words replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(80, 250))]
        c = [("zz" + x if rng.random() < share else x) for x in w]
        out.append((" ".join(w), " ".join(c)))
    return out


def test_copies_of_similarity_beyond_eight_tenths_are_caught(spark):
    pairs = [p for s in (0.005, 0.01, 0.02, 0.09) for p in planted(int(s * 1000), 150, s)]
    similar = [0.8 <= jaccard(a, b) < 1 for a, b in pairs]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.id: r.grp for r in simhash.near_groups(spark.createDataFrame(
        rows, "doc_id long, text string")).collect()}
    caught = [got[2 * i] == got[2 * i + 1] for i, ok in enumerate(similar) if ok]
    assert len(caught) > 150 and np.mean(caught) >= 0.95
    low = [got[2 * i] == got[2 * i + 1] for i, (a, b) in enumerate(pairs) if jaccard(a, b) < 0.5]
    assert len(low) > 50 and np.mean(low) <= 0.02
    assert all(got[2 * i] != got[2 * j] for i, j in zip(range(300), range(1, 301)))


def test_one_near_keeps_the_smallest_of_each_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_LEAST", 20)
    pairs = planted(4, 40, 0.004)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    rows += [(500, None), (501, ""), (502, " "), (503, "few words"), (504, "Few words"),
             (None, pairs[0][0]), (3, pairs[1][1]), (3, pairs[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node",
                                                                             "2 AS grp")
    kept = [r.doc_id for r in simhash.one_near(docs).collect()]
    group = brute_near([r for r in rows if r[0] is not None])
    assert sorted(kept) == sorted(set(group.values()))
    assert simhash.one_near(docs.limit(0)).count() == 0
