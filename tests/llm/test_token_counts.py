import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from isochord.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = ["don't 's''s 're 'rx ''t a'lls 'l 12é½", "İΣΑΣ ſ K", "<|endoftext|>x<|startoftext|> <|EndOfText|>",
        "áb \u0085x y​z w \x1c\x1f\x0b\x00q", "", "ǅ ﬁ", "日本語テスト😀", "'", "'r", "'l",
        "'ll", "x'", "'re've'm'd'l l'r", "ᲉꟋ1 \U000105c0", " \n", "'s" * 500, "a" * 40000,
        "1" * 3000, "a\U00016ea5a \U00016ea0\U00016ebb", "́x é"]


def texts():
    rng = random.Random(1)
    near = ["".join(rng.choice("aeiourstlmdv' '.1é\n") for _ in range(rng.randint(1, 60)))
            for _ in range(3000)]
    far = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x80, 0x24F),
                                   rng.randint(0x300, 0x2FFF), rng.randint(0x10000, 0x1FFFF)]))
                   for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    return EDGE + near + far


def library_counts(rows):
    library = Library.from_file(PATH)
    return [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]


def test_equals_the_library():
    rows = texts()
    own = tc.Tokenizer(open(PATH).read())
    got = np.concatenate([own.counts(rows[i:i + 700]) for i in range(0, len(rows), 700)])
    assert got.tolist() == library_counts(rows)


def test_small_tables_start_anew_and_stay_right(monkeypatch):
    monkeypatch.setattr(tc, "MOST_WORDS", 50)
    monkeypatch.setattr(tc, "MOST_STATES", 40)
    rows = texts()[:1200]
    assert tc.Tokenizer(open(PATH).read()).counts(rows).tolist() == library_counts(rows)


def test_scan_of_chunk_maps_equals_a_walk():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 10, 5000).astype(np.uint8)
    symbols[-1] = tc.SPACE
    grid = symbols[:4864].reshape(-1, tc.CHUNK).T
    state, want = tc.START, []
    for i, s in enumerate(symbols[:4864]):
        if i % tc.CHUNK == 0:
            want.append(state)
        state = tc.MOVE[state * 10 + s]
    assert tc.entry_states(tc.state_maps(grid)).tolist() == want


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (None, None), (2, ""), (2, "é" * 3000)],
                                 "doc_id long, text string").selectExpr("*", "1 AS row",
                                                                        "'a' AS n_tokens")
    got = tc.counted(docs, PATH).collect()
    want = library_counts([r.row.text or "" for r in got])
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((r.row.text or "").encode()) for r in got]
    assert [r.over_limit for r in got] == [n > 2048 for n in want]
    assert tc.counted(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["documents"])
def test_whole_table(spark, name):
    from isochord.llm.queries import QUERIES
    got = QUERIES["op9_token_counts"](spark, "/root/testdata/sf0.001").collect()
    texts_ = {r.doc_id: r.text or "" for r in
              spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()}
    ids = [r.doc_id for r in got]
    assert sorted(ids) == sorted(texts_)
    assert [r.n_tokens for r in got] == library_counts([texts_[i] for i in ids])
