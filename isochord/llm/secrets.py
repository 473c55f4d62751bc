"""Secrets: fixed rules, and a character network over every other candidate in its context.

The rules find assignments to telling names, access keys and hexadecimal strings. Candidates
are all other runs of at least eight characters of keys and addresses, runs as long of any
characters but spaces, quotes, brackets and commas, and runs of any length after a separator or a
telling name; of runs that a rule's finding covers in part, what it leaves over. Each is scored,
whole and with the characters around it, by a convolutional network in numpy: one layer of
five-character filters, their maxima over the candidate and over its context, and a logistic output.

The network is trained on labelled findings: what the rules find in a bounded sample of
documents, the same findings under other names and in other writing. Candidates that the rules do
not match are unlabelled, for the network is there to find secrets among them: counterexamples are
only those of a harmless form with no telling name near, some ordinary words, both also under names
that tell nothing, and names of secrets themselves. All forms of one value go to the same part: one
part trains, one calibrates the outputs, and on the third the threshold is set, the highest that
still finds the required share of its findings. Without findings or
counterexamples there is no network, and the rules stand alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochord.llm.rows import packed
from isochord.session import written

#: Documents that the network is trained on (chosen by hash), and findings and counterexamples
#: taken from them, at most.
SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 6_000
#: Share of held-back findings that a threshold is to keep, and the share of held-back
#: counterexamples that may reach it.
RECALL, ALARMS = 0.98, 0.002
CONTEXT, WIDTH, FILTERS = 24, 5, 24
STEPS, BATCH, RATE = 400, 64, 0.1
#: Characters of candidates scored at once.
CELLS = 1 << 17

# Kinds in the order of the report, and their patterns.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@-]{8,}")
RUN = re.compile(r"[^\s\"'`<>()\[\]{},;|\\]{8,}")
AFTER_SIGN = re.compile(r"(?<=[:=>])[\"'`]?[ \t]*[\"'`]?([^\s\"'`<>()\[\]{},;|\\]+)")
WORD = re.compile(r"\w+")
AFTER_WORD = re.compile(r"[\"'`]?(?:[ \t]+is)?[ \t:=>-]+[\"'`]?([^\s\"'`<>()\[\]{},;|\\]+)")
PLAIN_WORD = re.compile(r"[^\W\d_]{6,}")
NAMES = ("passw", "secret", "token", "api")
VALUE_NAMES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
DIGIT = re.compile(r"[0-9]")
#: Names and separators under which findings are shown to the network again.
OTHER_NAMES = ("pwd", "credential", "auth", "bearer", "private_key", "access key", "pass")
SEPARATORS = (" ", ": ", " = ", "=", " is ", " -> ")
#: Digits as letters.
LETTERS = str.maketrans("0123456789", "oKzEaSbTBg")
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Names under which harmless runs are shown again.
PLAIN_NAMES = ("name", "title", "file", "page", "order", "date", "version", "see")
#: Near any of these an unmatched candidate may be a secret.
TELLING = re.compile(r"pass|pwd|secret|token|key|credential|auth|bearer|private|login|://", re.I)
PARTS = re.compile(r"[^\W_]+")
TURN = re.compile(r"[^\W\d_](?=\d)|\d(?=[^\W\d_])|[a-z](?=[A-Z])|[A-Z]{2}(?=[a-z])")


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the rules, in the order of the report."""
    spans = []
    low = text.lower()
    if any(name in low for name in NAMES):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text)
                  if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 18]
    # shorter runs fail, and a run has no second match
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets, in order; of those that touch findings of the rules, the rest."""
    found = {m.span() for m in CANDIDATE.finditer(text)}
    found.update([m.span() for m in RUN.finditer(text)])
    if ":" in text or "=" in text or ">" in text:
        found.update([m.span(1) for m in AFTER_SIGN.finditer(text)])
    low = text.lower()
    if any(name in low for name in VALUE_NAMES):
        # each word is looked at once, however often it holds a name, and none inside a value
        done = 0
        for word in WORD.finditer(text):
            own = word[0].lower()
            if word.start() >= done and any(name in own for name in VALUE_NAMES):
                after = AFTER_WORD.match(text, word.end())
                if after:
                    found.add(after.span(1))
                    done = after.end()
    return sorted(_uncovered(text, found, known) if known else found)


def _uncovered(text: str, found: set, known: list[tuple[int, int, int]]) -> set:
    """What findings leave of the runs, if it holds a letter or digit."""
    joined: list[list[int]] = []
    for s, e, _ in known:
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    starts, left = [s for s, _ in joined], set()
    for a, b in found:
        at, k = a, max(bisect_right(starts, a) - 1, 0)
        while k < len(joined) and joined[k][0] < b:
            if at < joined[k][0]:
                left.add((at, joined[k][0]))
            at = max(at, joined[k][1])
            k += 1
        if at < b:
            left.add((at, b))
    return {(a, b) for a, b in left if (a, b) in found or PARTS.search(text, a, b)}


def outermost(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without the spans that lie in others."""
    kept: list[tuple[int, int, int]] = []
    for one in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not kept or one[1] > kept[-1][1]:
            kept.append(one)
    return kept


def harmless(text: str, a: int, b: int) -> bool:
    """Whether a run may serve as a counterexample: few turns between letters, digits and cases,
    no long unbroken part, and no telling name near. Capitals are words like others if they are
    letters alone."""
    run = text[a:b]
    return (len(TURN.findall(run)) <= max(1, len(run) // 6)
            and all(len(p) < (12 if p.isupper() and not p.isalpha() else 24)
                    for p in PARTS.findall(run))
            and not TELLING.search(text, max(0, a - 2 * CONTEXT), b + CONTEXT))


def form(run: str) -> int:
    """Counterexamples are taken in equal numbers of each: with a digit, with no small letter,
    with other signs, and plain."""
    if DIGIT.search(run):
        return 0
    if run.upper() == run:
        return 1
    return 3 if run.isalpha() else 2


def report(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _codes(text: str) -> np.ndarray:
    """1..95 for printable ASCII, 96 for others; 0 is past the ends."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 31, 96)


def _example(left: str, inside: str, right: str) -> tuple[np.ndarray, int, int]:
    """(codes, start, end) with full margins; codes of the candidate are raised by 97."""
    codes = np.zeros(2 * CONTEXT + len(inside), np.int64)
    left, right = left[-CONTEXT:], right[:CONTEXT]
    codes[CONTEXT - len(left):CONTEXT] = _codes(left)
    codes[CONTEXT:CONTEXT + len(inside)] = _codes(inside) + 97
    codes[CONTEXT + len(inside):CONTEXT + len(inside) + len(right)] = _codes(right)
    return codes, CONTEXT, CONTEXT + len(inside)


def example(text: str, a: int, b: int) -> tuple[np.ndarray, int, int]:
    return _example(text[max(0, a - CONTEXT):a], text[a:b], text[b:b + CONTEXT])


@dataclass
class Network:
    """Filters over one-hot characters, maxima inside and around, a logistic output."""
    filters: np.ndarray   # [WIDTH, 194, FILTERS]
    shift: np.ndarray     # [FILTERS]
    out: np.ndarray       # [2 * FILTERS]
    bias: float
    slope: float = 1.0
    level: float = 0.0
    threshold: float = 1.0
    #: shares of held-back findings and counterexamples that reach the threshold
    recall: float = 0.0
    alarms: float = 0.0

    def maxima(self, batch: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(padded codes, [row, 2 * FILTERS] maxima, their positions); filters end at 0."""
        longest = max(len(c) for c, _, _ in batch)
        codes = np.zeros((len(batch), longest + WIDTH - 1), np.int64)
        inside, there = np.zeros((2, len(batch), longest), bool)
        for i, (c, a, b) in enumerate(batch):
            codes[i, WIDTH // 2:WIDTH // 2 + len(c)] = c
            inside[i, a:b] = there[i, :len(c)] = True
        act = self.shift + sum(self.filters[j][codes[:, j:j + longest]] for j in range(WIDTH))
        low = np.float32(-1e9)
        first = np.where(inside[:, :, None], act, low)
        second = np.where((there & ~inside)[:, :, None], act, low)
        at = np.concatenate((first.argmax(1), second.argmax(1)), axis=1)
        top = np.concatenate((first.max(1), second.max(1)), axis=1)
        return codes, np.maximum(top, 0), at

    def logits(self, batch: list) -> np.ndarray:
        return self.maxima(batch)[1] @ self.out + self.bias

    def scores(self, examples: list) -> np.ndarray:
        """Calibrated probabilities."""
        z = self.slope * self.outputs(examples) + self.level
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def outputs(self, examples: list) -> np.ndarray:
        """``logits`` of any number; candidates of like length are taken together, long ones in
        parts whose maxima are joined, so that none is cut short."""
        z = np.zeros(len(examples))
        order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
        at = 0
        while at < len(order):
            n = len(examples[order[at]][0])
            if n > CELLS // 8:
                z[order[at]] = self._long(examples[order[at]])
                at += 1
                continue
            to = at + 1
            while (to < len(order) and (to - at + 1) * len(examples[order[to]][0]) <= CELLS // 8
                   and len(examples[order[to]][0]) <= 2 * n):
                to += 1
            rows = order[at:to]
            z[rows] = self.logits([examples[i] for i in rows])
            at = to
        return z

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the filters' first and second two places, for each pair of codes, and the last."""
        f = self.filters.astype(np.float32)
        return ((f[0][:, None] + f[1][None, :]).reshape(-1, FILTERS),
                (f[2][:, None] + f[3][None, :]).reshape(-1, FILTERS), f[4] + self.shift)

    def good(self, texts: list[str], spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Whether each (text, start, end) reaches the threshold: as ``scores`` has it, all
        candidates of one length at once, so that every run of a table can be scored."""
        margin = CONTEXT + WIDTH // 2
        parts, offset, at = [np.zeros(margin, np.int64)], [], margin
        for text in texts:
            offset.append(at)
            parts += [_codes(text), np.zeros(margin, np.int64)]
            at += len(text) + margin
        codes = np.concatenate(parts)
        where = np.array(spans, np.int64).reshape(-1, 3)
        start = np.array(offset, np.int64)[where[:, 0]] + where[:, 1]
        length = where[:, 2] - where[:, 1]
        z = np.zeros(len(where))
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[rows[0]])
            whole = n + 2 * CONTEXT
            if whole > CELLS // 8:
                z[rows] = [self._long(example(texts[i], a, b)) for i, a, b in where[rows]]
                continue
            step = max(1, CELLS // 8 // whole)
            for lo in range(0, len(rows), step):
                some = rows[lo:lo + step]
                c = codes[np.arange(-margin, n + margin)[:, None] + start[some]]
                c[:WIDTH // 2] = c[-(WIDTH // 2):] = 0
                c[margin:margin + n] += 97
                z[some] = self._alike(c, n)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.level, -30, 30))) >= self.threshold

    def _alike(self, c: np.ndarray, n: int) -> np.ndarray:
        """Outputs for columns of codes of whole margins and ``n`` characters inside."""
        first, second, last = self._pairs
        pair = c[:-1] * 194 + c[1:]
        act = first.take(pair[:-3], axis=0, mode="clip")
        act += second.take(pair[2:-1], axis=0, mode="clip")
        act += last.take(c[4:], axis=0, mode="clip")
        inside = act[CONTEXT:CONTEXT + n].max(0)
        outside = np.maximum(act[:CONTEXT].max(0), act[CONTEXT + n:].max(0))
        top = np.maximum(np.concatenate((inside, outside), axis=1), 0)
        return top @ self.out + self.bias

    def _long(self, one: tuple) -> float:
        codes, a, b = one
        step, edge, best = CELLS // 8, WIDTH // 2, None
        for lo in range(0, len(codes), step):
            hi = min(lo + step, len(codes))
            # filters look over the cut, and positions beyond it count with their own part
            before, after = max(lo - edge, 0), min(hi + edge, len(codes))
            part = codes[before:after]
            padded = np.zeros(len(part) + WIDTH - 1, np.int64)
            padded[edge:edge + len(part)] = part
            act = self.shift + sum(self.filters[j][padded[j:j + len(part)]] for j in range(WIDTH))
            act = act[lo - before:hi - before]
            inside = (np.arange(lo, hi) >= a) & (np.arange(lo, hi) < b)
            top = np.concatenate([act[m].max(0, initial=0) for m in (inside, ~inside)])
            best = top if best is None else np.maximum(best, top)
        return float(best @ self.out + self.bias)


def parts_of(label: np.ndarray, groups: np.ndarray, rng) -> list[np.ndarray]:
    """Rows for training (three fifths of the groups), calibration and threshold (one each);
    a group, whatever its labels, lies in one part, and groups with findings are dealt first."""
    _, of = np.unique(groups, return_inverse=True)
    found = np.zeros(of.max() + 1, bool)
    found[of[label == 1]] = True
    part = np.zeros(len(found), int)
    for kind in (True, False):
        some = np.flatnonzero(found == kind)
        part[rng.permutation(some)] = np.array([1, 2, 0, 0, 0])[np.arange(len(some)) % 5]
    return [np.flatnonzero(part[of] == k) for k in range(3)]


def fitted(examples: list, label: np.ndarray, groups: np.ndarray | None = None,
           recall: float = RECALL, alarms: float = 1.0, seed: int = 0) -> Network | None:
    """Trains on three fifths of the groups (each example its own if none are given), calibrates
    on a fifth and sets the threshold on another: the highest that keeps ``recall`` of its
    findings, or a higher one if more than ``alarms`` of its counterexamples would reach it. Both
    shares as measured there are kept with the network."""
    if len(np.unique(label)) < 2 or min(label.sum(), (1 - label).sum()) < 10:
        return None
    rng = np.random.default_rng(seed)
    train, back, last = parts_of(label, np.arange(len(label)) if groups is None else groups, rng)
    if any(len(np.unique(label[x])) < 2 for x in (train, back, last)):
        return None
    n = Network(rng.normal(0, 0.1, (WIDTH, 194, FILTERS)).astype(np.float32),
                np.zeros(FILTERS, np.float32),
                rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)
    kinds = [train[label[train] == k] for k in (0, 1)]
    past = [np.full(x.shape, 1e-6, np.float32) for x in (n.filters, n.shift, n.out)]
    for _ in range(STEPS):
        rows = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        batch = [examples[i] for i in rows]
        codes, top, at = n.maxima(batch)
        z = np.clip(top @ n.out + n.bias, -30, 30)
        error = ((1 / (1 + np.exp(-z)) - label[rows]) / len(rows)).astype(np.float32)
        back_top = error[:, None] * n.out * (top > 0)
        g_out, g_filters = top.T @ error, np.zeros_like(n.filters)
        which = np.tile(np.arange(FILTERS), 2)
        for j in range(WIDTH):
            seen = codes[np.arange(len(rows))[:, None], at + j]
            np.add.at(g_filters[j], (seen, which[None, :]), back_top)
        g_shift = back_top.sum(0).reshape(2, FILTERS).sum(0)
        for x, g, p in zip((n.filters, n.shift, n.out), (g_filters, g_shift, g_out), past):
            p += g * g
            x -= (RATE * g / np.sqrt(p)).astype(np.float32)
        n.bias -= float(error.sum())
    z = n.outputs([examples[i] for i in back])
    y = label[back]
    scale = max(float(np.abs(z).max()), 1e-6)
    for _ in range(500):    # logistic regression of the label on the output
        p = 1 / (1 + np.exp(-np.clip(n.slope * z + n.level, -30, 30)))
        n.slope -= 2 / scale * float(((p - y) * z / scale).mean())
        n.level -= 0.5 * float((p - y).mean())
    held = np.sort(n.scores([examples[i] for i in last[label[last] == 1]]))
    others = np.sort(n.scores([examples[i] for i in last[label[last] == 0]]))[::-1]
    n.threshold = float(max(held[int(np.floor((1 - recall) * len(held)))],
                            np.nextafter(others[int(alarms * len(others))], 2)
                            if int(alarms * len(others)) < len(others) else 0))
    n.recall = float((held >= n.threshold).mean())
    n.alarms = float((others >= n.threshold).mean())
    return n


def _rank(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            known = rule_spans(text or "")
            # no unmatched candidate is a counterexample unless it is harmless; of plain words
            # one in 64, by a hash that is the same everywhere
            plain = [(m.start(), m.end()) for m in PLAIN_WORD.finditer(text or "")
                     if all(m.end() <= a or b <= m.start() for a, b, _ in known)]
            other = [(a, b, 3) for a, b in {*candidates(text or "", known), *plain}
                     if (form(text[a:b]) < 3 or zlib.crc32(text[a:b].encode()) % 64 == 0)
                     and harmless(text, a, b)]
            for found, kind in ((known, 1), (other, 0)):
                for a, b, k in found:
                    if k == 0:      # an assignment is shown by its value
                        a = ASSIGN.match(text, a).start(1)
                    rows.append({"label": kind, "form": -1 if kind else form(text[a:b]), "before": text[max(0, a - CONTEXT):a],
                                 "inside": text[a:b], "after": text[b:b + CONTEXT]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema(
            [("label", pa.int32()), ("form", pa.int32()), ("before", pa.string()),
             ("inside", pa.string()), ("after", pa.string())]))


def _false_alarms(network):
    """Harmless candidates that the network reports nevertheless."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network = network.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo in range(0, len(texts), 200):
                some = texts[lo:lo + 200]
                at = [(i, a, b) for i, text in enumerate(some)
                      for a, b in candidates(text, rule_spans(text)) if harmless(text, a, b)]
                rows = [(some[i][max(0, a - CONTEXT):a], some[i][a:b], some[i][b:b + CONTEXT])
                        for (i, a, b), ok in zip(at, model.good(some, at)) if ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.string()) for k in range(3)],
                    ["before", "inside", "after"])
    return find


def learned(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
            sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS,
            recall: float = RECALL) -> Network | None:
    """The network of a sample of documents (about ``sample_docs``, by hash of id and text)."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    text = F.col(f"`{text_col}`")
    chosen = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(1 << 30)) < share * (1 << 30)
    # bounded, so that it can be dealt to all tasks
    sample = written(docs.filter(chosen).select(F.coalesce(text, F.lit("")).alias("text"))
                     .repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")
    kind = "before string, inside string, after string"
    rows = written(sample.mapInArrow(_training_rows, f"label int, form int, {kind}").distinct(),
                   "training")

    def some(of: DataFrame, most: int) -> list:
        return of.orderBy(F.xxhash64("before", "inside", "after"), "before", "inside",
                          "after").limit(most).collect()
    found = some(rows.filter("label = 1"), sample_rows)
    plain = [r for k in range(4) for r in some(rows.filter(F.col("form") == k), sample_rows // 4)]
    first = fitted(*_shown(found, plain), recall, ALARMS)
    if first is None:
        return None
    # what the first network reports wrongly in the sample teaches the second
    model = docs.sparkSession.sparkContext.broadcast(first)
    alarms = some(sample.mapInArrow(_false_alarms(model), kind).distinct(), sample_rows // 2)
    return fitted(*_shown(found, plain + alarms), recall, ALARMS)


def _shown(found: list, plain: list) -> tuple[list, np.ndarray, np.ndarray]:
    """(examples, labels, groups) of findings and counterexamples (before, inside, after), each as
    it is and in other writing."""
    examples, label, groups = [], [], []
    words = [w for r in plain for w in PARTS.findall(r.inside) if w.isalpha()]
    for kind, r in [*((1, r) for r in found), *((0, r) for r in plain)]:
        pick = _rank(r.before + r.inside)
        own = OTHER_NAMES if kind else PLAIN_NAMES
        sign = SEPARATORS[pick[1] % len(SEPARATORS)]
        before = r.before[:8] + own[pick[0] % len(own)] + sign
        shown = [(r.before, r.inside, kind), (before, r.inside, kind)]
        if kind:
            other, joined = _other_forms(r.inside, pick, words)
            shown += [(before + head, inside, 1) for head, inside in other]
            shown += [(r.before + head, inside, 1) for head, inside in other if head]
            # letters alone are a secret after a telling name, and none after others; nor is the
            # name itself
            shown += [(before, inside, 1) for inside in joined]
            shown += [(r.before[:8] + PLAIN_NAMES[pick[15] % len(PLAIN_NAMES)] + sign, inside, 0)
                      for inside in joined]
            examples.append(_example(r.before[:8] + " ", own[pick[0] % len(own)],
                                     sign + r.inside + r.after))
            label.append(0)
            groups.append(int.from_bytes(_rank(r.inside)[:7]))
        for head, inside, k in shown:
            examples.append(_example(head, inside, r.after))
            label.append(k)
            groups.append(int.from_bytes(_rank(r.inside)[:7]))
    return examples, np.array(label, int), np.array(groups, np.int64)


def _other_forms(value: str, pick: bytes, words: list[str]
                 ) -> tuple[list[tuple[str, str]], list[str]]:
    """(characters before, candidate) of a finding's value in letters alone, short, with further
    signs and as what follows the end of a rule's match; and words joined together, of the sample
    and invented."""
    letters = value.translate(LETTERS)
    sign = "@!#$%&*"[pick[3] % 7]
    half = len(value) // 2
    joined = "".join(words[int.from_bytes(pick[k:k + 4], "big") % len(words)].capitalize()
                     for k in (4, 7, 10, 12)[:2 + pick[2] % 3]) if words else letters
    return [("", letters), ("", value[:4 + pick[2] % 5]), ("", value[:half] + sign + value[half:]),
            # not so much before it that the name is out of sight
            (value[:min(half, 12)], sign + value[half:])], [joined, spoken(pick)]


def spoken(pick: bytes) -> str:
    """Two to four invented words of consonants and vowels in turn, joined, from these bytes."""
    draw, words = hashlib.sha256(pick).digest(), []
    for k in range(2 + draw[0] % 3):
        part = draw[1 + 7 * k:8 + 7 * k]
        turn = part[0] % 2
        words.append("".join((VOWELS if (i + turn) % 2 else CONSONANTS)[x % (5 if (i + turn) % 2 else 21)]
                             * (2 if i and x > 225 else 1)
                             for i, x in enumerate(part[:4 + part[1] % 4])).capitalize())
    return "".join(words)


REPORT = "n_assign long, n_access long, n_hex long, base string, spans string"


def _finder(network):
    @F.arrow_udf(REPORT)
    def find(column: pa.Array) -> pa.Array:
        model: Network | None = network.value
        out, held, texts, waiting = [], [], [], []

        def settle():
            """``texts`` are those of the last rows of ``held``."""
            if waiting:
                added = [[] for _ in texts]
                for (i, a, b), ok in zip(waiting, model.good(texts, waiting)):
                    if ok:
                        added[i].append((a, b, 3))
                for spans, more in zip(held[-len(texts):], added):
                    spans += outermost(more)
            waiting.clear()
            texts.clear()
        size = 0
        for text in column.to_pylist():
            text = text or ""
            known = rule_spans(text)
            kinds = [k for _, _, k in known]
            out.append((kinds.count(0), kinds.count(1), kinds.count(2), report(known)))
            held.append(list(known))
            if model is not None:
                waiting += [(len(texts), a, b) for a, b in candidates(text, known)]
                texts.append(text)
                size += len(text)
                if size > 2 * CELLS:
                    settle()
                    size = 0
        settle()
        columns = list(zip(*out)) if out else [(), (), (), ()]
        spans = [report(sorted(s, key=lambda x: (x[0], x[2]))) for s in held]
        return pa.StructArray.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()),
             pa.array(spans, pa.string())],
            names=["n_assign", "n_access", "n_hex", "base", "spans"])
    return find


def secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
            train_on: DataFrame | None = None, **options) -> DataFrame:
    """(row, n_assign, n_access, n_hex, base, spans) for each row of ``docs``.

    ``base`` and ``spans`` list findings of the rules, and all findings, as kind:start:end joined
    by commas, in code points, ordered by start and kind; the network adds spans of kind
    ``model`` which touch none of the rules'. A NULL text is empty and has none; whole texts are
    searched; rows that repeat are found alike. ``row`` holds all columns of ``docs``, of which
    others may be NULL. An empty table gives no rows. ``train_on`` are documents with the same
    two columns to train the network on; ``docs`` itself if there are none.
    """
    model = learned(docs if train_on is None else train_on, text_col, id_col, **options)
    find = _finder(docs.sparkSession.sparkContext.broadcast(model))
    rows = packed(docs)
    return rows.select("row", find(F.col(f"row.`{text_col}`")).alias("f")).select("row", "f.*")
