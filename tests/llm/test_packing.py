import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isochord.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = ["", " ", "don't 's", "<|endoftext|>x<|startoftext|> <|end", "áb \u0085x y​z w \x1c\x1f\x0bq",
        "İΣΑΣ ſ K ΑΣ", " ́x é", "日本語テスト😀", "a" * 5000, "1" * 3000, "'s" * 500, "\x00 \x00\x0ca"]


def texts():
    rng = random.Random(5)
    near = ["".join(rng.choice("aeiourstlmdv' '.1é\n\t<|>́") for _ in range(rng.randint(1, 60)))
            for _ in range(1500)]
    far = ["".join(chr(rng.choice([rng.randint(9, 126), rng.randint(0x80, 0x24F),
                                   rng.randint(0x300, 0x2FFF), rng.randint(0x10000, 0x1FFFF)]))
                   for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return EDGE + near + far + [" ".join(rng.choice(near) for _ in range(2000))]


def library_ids(rows):
    library = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in library.encode_batch(list(rows), add_special_tokens=False)]


def brute_bins(lengths, capacity):
    """Fewest bins, by trying every way to place the pieces in descending order."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for r in {b for b in bins if b >= lengths[i]}:
            at = bins.index(r)
            go(i + 1, [*bins[:at], r - lengths[i], *bins[at + 1:]])
        go(i + 1, [*bins, capacity - lengths[i]])
    go(0, [])
    return best


def plain_bfd(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def check_places(rows, limit):
    """[(sequence, offset, length)] lie in sequences without gap or overlap; returns their number."""
    rows = sorted(rows)
    for _, members in itertools.groupby(rows, key=lambda r: r[0]):
        at = 0
        for _, offset, length in members:
            assert offset == at
            at += length
        assert at <= limit
    return len({r[0] for r in rows})


@pytest.mark.parametrize("most", [500_000, 40])
def test_ids_equal_the_library(monkeypatch, most):
    monkeypatch.setattr(pk, "MOST_CHUNKS", most)
    rows = texts()
    own = pk.Ids(open(PATH, encoding="utf-8").read(), 0)
    got = []
    for i in range(0, len(rows), 500):
        flat, ends = own.of([t.encode() for t in rows[i:i + 500]])
        got += [x.tolist() for x in np.split(flat, ends[:-1])]
    assert got == library_ids(rows)


@pytest.mark.parametrize("limit", [1, 7, 2048])
def test_pieces(spark, limit):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(None, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS piece",
                                                                             "1 AS row")
    got = {}
    for r in pk.pieces(docs, PATH, limit).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids) and r.start == r.piece * limit
        got.setdefault((r.row.doc_id, r.row.text), {}).setdefault(r.piece, []).append(ids)
    for (i, t), ids in zip({(i, t): 0 for i, t in rows}, library_ids(
            t or "" for i, t in {(i, t): 0 for i, t in rows})):
        want = [ids[k:k + limit] for k in range(0, len(ids), limit)]
        times = 2 if t == "twice" else 1
        assert got[i, t] == {k: [w] * times for k, w in enumerate(want)}
    assert pk.pieces(docs.limit(0), PATH, limit).count() == 0


def test_best_fit_decreasing_is_a_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(300):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 80))
        bins, offsets = pk.best_fit_decreasing(lengths, capacity)
        n = check_places(zip(bins.tolist(), offsets.tolist(), lengths.tolist()), capacity)
        assert n == plain_bfd(lengths.tolist(), capacity)
        assert sorted(set(bins.tolist())) == list(range(n))


def test_bound_is_never_above_the_optimum_and_often_meets_it():
    rng = np.random.default_rng(1)
    met = better = 0
    for _ in range(400):
        capacity = int(rng.integers(3, 40))
        low = int(rng.integers(1, capacity))
        lengths = rng.integers(low, capacity + 1, rng.integers(1, 9))
        bound = pk.lower_bound(*np.unique(lengths, return_counts=True), capacity)
        best = brute_bins(lengths.tolist(), capacity)
        assert bound <= best, (lengths, capacity)
        met += bound == best
        better += bound > -(-int(lengths.sum()) // capacity)
    assert met >= 380 and better > 50
    assert pk.lower_bound(np.array([6]), np.array([100]), 11) == 100
    assert pk.lower_bound(np.array([4]), np.array([100]), 11) == 50
    assert pk.lower_bound(np.zeros(0, int), np.zeros(0, int), 11) == 0


def lengths_frame(spark, lengths):
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)],
                                 "id long, length long").repartition(5)


def test_exchange_lowers_the_number_of_sequences(spark):
    rng = np.random.default_rng(2)
    # pieces that fill sequences exactly in pairs and triples, and do so rarely inside a partition
    a = rng.integers(300, 1700, 3000)
    lengths = np.concatenate((a, 2048 - a))
    rows = lengths_frame(spark, lengths)
    got = pk.placed(rows, 2048, part_rows=300).collect()
    n = check_places([(r.sequence_id, r.offset, r.piece.length) for r in got], 2048)
    assert sorted(r.piece.id for r in got) == list(range(6000))
    dealt = sum(plain_bfd(p.tolist(), 2048) for p in np.array_split(rng.permutation(lengths), 20))
    assert n < dealt - 10


def test_one_partition_equals_best_fit_decreasing(spark):
    lengths = np.random.default_rng(3).integers(1, 2049, 2000)
    got = pk.placed(lengths_frame(spark, lengths), 2048).collect()
    n = check_places([(r.sequence_id, r.offset, r.piece.length) for r in got], 2048)
    assert n == plain_bfd(lengths.tolist(), 2048)


def test_equal_and_whole_pieces_and_nothing(spark):
    rows = spark.range(5000).selectExpr("1 AS id", "if(id % 2 = 0, 100L, 10L) AS length",
                                        "2 AS piece", "3 AS part", "4 AS sequence_id")
    got = pk.placed(rows, 100, part_rows=512).collect()
    assert check_places([(r.sequence_id, r.offset, r.piece.length) for r in got], 100) == 2750
    assert got[0].piece.sequence_id == 4
    assert pk.placed(rows.limit(0), 100).count() == 0
    for bad in ("0L", "101L", "CAST(NULL AS LONG)"):
        with pytest.raises(PySparkException):
            pk.placed(rows.withColumn("length", F.expr(bad)), 100).count()


def test_sequences_hold_the_ids(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [np.frombuffer(r.ids, "<u4").tolist() for r in
           pk.packed_documents(docs, PATH, 64).collect()]
    assert max(map(len, got)) <= 64
    want = library_ids(t for _, t in rows)
    assert sum(map(len, got)) == sum(map(len, want))
    parts = sorted(tuple(x[k:k + 64]) for x in want for k in range(0, len(x), 64))
    cuts = []
    for ids in got:
        at = [i + 1 for i, x in enumerate(ids) if x == 0]
        at = at if at and at[-1] == len(ids) else [*at, len(ids)]
        cuts += [tuple(ids[a:b]) for a, b in zip([0, *at[:-1]], at)]
    assert sum(len(p) for p in parts) == sum(len(c) for c in cuts)
    assert {p for p in parts if p[-1] == 0} <= set(cuts) | {p for p in parts if 0 in p[:-1]}


def test_whole_table(spark):
    from isochord.llm.queries import QUERIES
    got = QUERIES["op12_packing"](spark, "/root/testdata/sf0.001").collect()
    rows = {r.doc_id: r.text or "" for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = dict(zip(rows, library_ids(rows.values())))
    want = {(d, p): (p * 2048, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
            for d, all_ in ids.items()
            for p, x in enumerate(all_[k:k + 2048] for k in range(0, len(all_), 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    n = check_places([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert n <= 1.01 * pk.lower_bound(
        *np.unique([r.length for r in got], return_counts=True), 2048) + 1
