import random
import re
import time

import numpy as np

from isochord.llm import secrets as sc

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def corpus():
    rng = random.Random(4)

    def key(n, chars="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        return "".join(rng.choice(chars) for _ in range(n))

    def prose(n):
        return " ".join(key(rng.randint(2, 8), "aeinorst") for _ in range(n))
    rows = []
    for i in range(150):
        rows.append(f"{prose(20)} token = \"{key(40, '0123456789abcdef')}\" {prose(9)}")
        rows.append(f"{prose(9)} Password:{key(20)} {prose(8)}")
        rows.append(f"{prose(9)} order-{rng.randint(1, 99)}-{prose(1)}-batch-{i}x {prose(9)}")
        rows.append(f"see report_{i}_of_{prose(1)}_final/v{i % 7} {prose(9)}")
    rows += [f"pwd = {key(24)} {prose(5)}" for _ in range(20)]
    return rows


EDGE = [None, "", "AKIA" + "A" * 14, "AKIA" + "A" * 13, "xAKIAAKIA" + "B" * 30 + "c",
        "secret: token: abcdefghijklmnop", "TOKEN='abcdefghijkl' apikey=short", "ſecret=abcdefghijklmn",
        "api_KEY\"  :  \"A.b-c_d=e/f+g0", "é" * 50 + " passwd=0123456789abcdef0123 " + "ü" * 5,
        "f" * 15, "f" * 16, "0" * 50_000 + "Z9" * 40_000, "toKen=" + "token=" * 5 + "a" * 12]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "1 AS row", "'s' AS spans", "NULL AS f")


def test_rules_equal_brute_force_and_stay(spark):
    texts = corpus() + EDGE
    known = [t for t in corpus() if not t.startswith("pwd")]
    got = sc.secrets(frame(spark, texts), train_on=frame(spark, known)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.base == brute(r.row.text)
        kinds = [s.split(":")[0] for s in r.base.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count,
                                                              ("assign", "access", "hex")))
        base, spans = (set(x.split(",")) - {""} for x in (r.base, r.spans))
        assert base <= spans and all(s.startswith("model:") for s in spans - base)
    added = [r.row.doc_id for r in got if "model:" in r.spans]
    new = [i for i, t in enumerate(texts) if t and t.startswith("pwd = ")]
    assert len(set(new) & set(added)) >= 15
    plain = [i for i, t in enumerate(texts) if t and (" order-" in t or t.startswith("see rep"))]
    assert len(set(plain) & set(added)) <= 0.1 * len(plain)


def test_empty_table_and_no_findings(spark):
    assert sc.secrets(frame(spark, ["x"]).limit(0)).count() == 0
    assert [r.spans for r in sc.secrets(frame(spark, ["plain", None])).collect()] == ["", ""]


def test_thresholds_keep_the_required_recall():
    rng = np.random.default_rng(1)
    chars = np.array(list("0123456789abcdefghij"))
    examples, label = [], []
    for i in range(400):
        text = "".join(rng.choice(chars, 20))
        examples.append(sc._example("name = " if i % 2 else "page ", text, " end"))
        label.append(i % 2)
    net = sc.fitted(examples, np.array(label))
    scores = net.scores(examples)
    y = np.array(label)
    assert (scores[y == 1] >= net.threshold).mean() > 0.9
    assert (scores[y == 0] >= net.threshold).mean() < 0.1


def test_long_candidates_are_scored_whole():
    net = sc.Network(np.random.default_rng(0).normal(size=(sc.WIDTH, 194, sc.FILTERS)).astype(
        np.float32), np.zeros(sc.FILTERS, np.float32),
        np.random.default_rng(1).normal(size=2 * sc.FILTERS).astype(np.float32), 0.1)
    text = "a1" * 15_000 + "Zq9/" + "a1" * 8_000
    one = sc.example("x = " + text + " y", 4, 4 + len(text))
    assert abs(net._long(one) - float(net.logits([one])[0])) < 1e-3


def test_candidates_of_long_texts_take_linear_time():
    for text in ("key" * 350_000, "key " * 260_000, ":" * 1_000_000, "pass=" * 200_000,
                 ": " * 500_000, "token" + " " * 1_000_000):
        t0 = time.process_time()
        sc.candidates(text, [])
        assert time.process_time() - t0 < 6, text[:6]


def test_names_inside_words_and_values_after_names():
    text = "mypassword is Xy1 and PWD->ab; authors 'qq' keys"
    found = {text[a:b] for a, b in sc.candidates(text, [])}
    assert {"Xy1", "ab", "qq"} <= found


def test_prose_in_capitals_raises_few_alarms(spark):
    rng = random.Random(21)

    def word():
        return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou")
                       for _ in range(rng.randint(2, 6)))
    texts = corpus()
    for i in range(200):
        loud = " ".join(word().upper() + rng.choice(("!!", "!!!", ".", "")) for _ in range(12))
        texts.append(" ".join(word() for _ in range(12)) + " " + loud + f" {word()}*** {word()}###")
    got = {r.row.doc_id: r for r in sc.secrets(frame(spark, texts)).collect()}
    first = len(corpus())
    assert sum("model:" in got[i].spans for i in range(first, len(texts))) <= 4


def test_unlabelled_secrets_in_the_training_table_are_found(spark):
    rng = random.Random(8)
    texts = corpus() + [f"{name}{rng.choice((' = ', ': '))}" + "".join(
        rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24))
        + " aeon rest" for name in ("bearer", "credential", "private_key") for _ in range(60)]
    got = sc.secrets(frame(spark, texts)).collect()     # as op7_secrets: trained on themselves
    added = {r.row.doc_id for r in got if "model:" in r.spans}
    new = [i for i, t in enumerate(texts)
           if t.startswith(("pwd = ", "bearer", "credential", "private_key"))]
    assert len(added.intersection(new)) >= 0.8 * len(new)
    plain = [i for i, t in enumerate(texts) if " order-" in t or t.startswith("see rep")]
    assert len(added.intersection(plain)) <= 0.1 * len(plain)


def test_letters_alone_short_ones_other_signs_and_rests_are_scored(spark):
    rng = random.Random(11)

    def key(n, chars):
        return "".join(rng.choice(chars) for _ in range(n))
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    new = [f"pwd: CorrectHorseBatteryStaple{c}" for c in ("", "Nine", "Blue")]
    new += [f"credential = {key(24, letters)} end" for _ in range(30)]
    new += [f"pwd = {key(6, letters + '23456789')} end" for _ in range(30)]
    new += [f"pwd: {key(9, letters)}!{key(9, letters + '23')} end" for _ in range(30)]
    new += [f"password={key(14, letters + '2345')}@{key(12, letters + '2345')} end"
            for _ in range(30)]
    texts = new + [t for t in corpus() if not t.startswith("pwd")]
    got = {r.row.doc_id: r for r in sc.secrets(frame(spark, texts)).collect()}
    share = [np.mean(["model:" in got[i].spans for i in part])
             for part in (range(3), range(3, 33), range(33, 63), range(63, 93), range(93, 123))]
    assert min(share) >= 0.6, share
    plain = [i for i, t in enumerate(texts) if " order-" in t or t.startswith("see rep")]
    assert np.mean(["model:" in got[i].spans for i in plain]) <= 0.1


def test_rests_of_runs_that_rules_cover_in_part():
    text = "x password=abcdefghijkl@rest9! AKIA" + "A" * 14 + "zz/tail key is Ab9"
    known = sc.rule_spans(text)
    found = [text[a:b] for a, b in sc.candidates(text, known)]
    assert "@rest9!" in found and "zz/tail" in found and "Ab9" in found
    assert all(b <= s or e <= a for a, b in sc.candidates(text, known) for s, e, _ in known)


def test_all_at_once_is_as_each_alone():
    rng = np.random.default_rng(2)
    net = sc.Network(rng.normal(size=(sc.WIDTH, 194, sc.FILTERS)).astype(np.float32),
                     rng.normal(size=sc.FILTERS).astype(np.float32),
                     rng.normal(size=2 * sc.FILTERS).astype(np.float32), 0.1)
    texts = ["", "pwd: aé", "".join(map(chr, rng.integers(32, 200, 900)))] + ["x" * 40_000]
    spans = [(1, 5, 7), (3, 5, 39_990)]
    spans += [(2, a, a + int(rng.integers(1, 60))) for a in range(0, 840, 7)]
    scores = net.scores([sc.example(texts[i], a, b) for i, a, b in spans])
    net.threshold = float(np.median(scores)) + 1e-5
    assert (net.good(texts, spans) == (scores >= net.threshold)).mean() > 0.98


def test_forms_of_one_value_share_a_part_and_parts_are_three(monkeypatch):
    label = np.array([1, 1, 0] * 200 + [0, 0] * 200)
    groups = np.concatenate([np.repeat(np.arange(200), 3), np.repeat(np.arange(200, 400), 2)])
    parts = sc.parts_of(label, groups, np.random.default_rng(3))
    assert sorted(np.concatenate(parts)) == list(range(len(label)))
    assert not any(set(groups[a]) & set(groups[b]) for a, b in zip(parts, parts[1:] + parts[:1]))
    assert [int(label[p].sum()) for p in parts] == [240, 80, 80]

    trained = []
    monkeypatch.setattr(sc.Network, "maxima", lambda self, batch, f=sc.Network.maxima: (
        trained.extend(batch) if len(batch) == sc.BATCH else None, f(self, batch))[1])
    text = [f"{g:03d}" + "abcdefg"[g % 7] * 12 for g in groups]
    sc.fitted([sc._example("pwd = " if y else "page ", x, "") for x, y in zip(text, label)],
              label, groups)
    seen = {tuple(c[a:a + 3] - 97) for c, a, _ in trained}
    held = {tuple(sc._codes(text[i][:3])) for p in parts[1:] for i in p}
    own = sc.parts_of(label, groups, np.random.default_rng(0))
    assert seen <= {tuple(sc._codes(text[i][:3])) for i in own[0]} and held
