"""Document quality by a factorisation machine over hashed words and the shape of the text.

Features are the distinct words of a text (hashed), statistics of its structure cut into
bins (shares of upper case, digits, punctuation, characters beyond ASCII, words that end alike,
repeated words and lines, lengths of words and lines) and what the text's own metadata say (its
length in bytes, words and lines). Each feature has a weight and a vector of ``RANK`` numbers; a
pair of features adds the product of their vectors. The sum over all pairs is half of (square of
the sum less sum of the squares), so a document is scored in time linear in its features.

The model is fitted on at most ``sample`` labelled rows, chosen by a hash; all documents are
scored where they lie, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochord.llm.rows import flat_utf8, packed, pieces_of
from isochord.llm.words import LOWER, NOT_SPACE, span_hashes, word_spans
from isochord.session import written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
BITS, RANK = 16, 8
SLICE_BYTES = 1 << 20
#: Gradient steps, the same number for any sample.
STEPS, BATCH, RATE, DECAY = 800, 128, 0.05, 1e-4

_POINTS = np.arange(256)
_CLASS = {
    "upper": (_POINTS >= 65) & (_POINTS <= 90), "lower": (_POINTS >= 97) & (_POINTS <= 122),
    "digit": (_POINTS >= 48) & (_POINTS <= 57), "beyond": _POINTS >= 128,
    "mark": ((_POINTS > 32) & (_POINTS < 48)) | ((_POINTS > 57) & (_POINTS < 65))
            | ((_POINTS > 90) & (_POINTS < 97)) | ((_POINTS > 122) & (_POINTS < 127)),
    "stop": np.isin(_POINTS, [44, 46]), "line": _POINTS == 10,
}
#: Upper bounds of the bins of shares, and of counts.
SHARES = np.array([0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 0.9])
COUNTS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 4096])
BINS = 24
STATISTICS = ("upper", "digit", "beyond", "mark", "mark_not_stop", "repeated_words",
              "repeated_lines", "capital_words", "marked_words", "bytes", "words", "lines",
              "word_length", "line_words", "commonest_word")
SIZE = (1 << BITS) + BINS * len(STATISTICS)


@dataclass
class Features:
    """Rows of features: those of row i are at index[start[i]:start[i + 1]]."""
    start: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, what, count) of the distinct pairs, in the order of the documents."""
    order = np.lexsort((what, doc))
    doc, what = doc[order], what[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (what[1:] != what[:-1])
    at = np.flatnonzero(new)
    return doc[at], what[at], np.diff(np.append(at, len(doc)))


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    """Features of texts that lie end to end; a text without words has its statistics only."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offsets, NOT_SPACE)
    hashes = span_hashes(low, starts, ends)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    sums = {k: _sums(table[data], offsets) for k, table in _CLASS.items()}
    at, bucket, times = _distinct(doc, (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    distinct = np.bincount(at, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, at, times)
    line_starts, line_ends, line_doc = word_spans(data, offsets, ~_CLASS["line"])
    lines = np.bincount(line_doc, minlength=n)
    kinds = np.bincount(_distinct(line_doc, span_hashes(data, line_starts, line_ends)
                                  .view(np.int64))[0], minlength=n)
    mark = _CLASS["mark"] & ~_CLASS["stop"]
    shares = {
        "upper": sums["upper"] / np.maximum(sums["upper"] + sums["lower"] + sums["beyond"], 1),
        "digit": sums["digit"] / size, "beyond": sums["beyond"] / size,
        "mark": sums["mark"] / size, "mark_not_stop": (sums["mark"] - sums["stop"]) / size,
        "repeated_words": 1 - distinct / some, "repeated_lines": 1 - kinds / np.maximum(lines, 1),
        "capital_words": np.bincount(doc, _CLASS["upper"][data[starts]], minlength=n) / some,
        "marked_words": np.bincount(doc, mark[data[ends - 1]], minlength=n) / some,
        "commonest_word": most / some,
    }
    counts = {"bytes": np.diff(offsets), "words": words, "lines": lines,
              "word_length": np.diff(offsets) / some, "line_words": words / np.maximum(lines, 1)}
    bins = np.stack([(1 << BITS) + BINS * i + (
        np.searchsorted(SHARES, shares[s]) if s in shares else np.searchsorted(COUNTS, counts[s]))
        for i, s in enumerate(STATISTICS)], 1)
    k = len(STATISTICS)
    start = np.concatenate(([0], np.cumsum(distinct + k)))
    index, value = np.empty(start[-1], np.int32), np.empty(start[-1], np.float32)
    place = start[at] + k + np.arange(len(at)) - (np.cumsum(distinct) - distinct)[at]
    index[place], value[place] = bucket, 1 / np.sqrt(distinct[at])
    head = (start[:-1, None] + np.arange(k)).ravel()
    index[head], value[head] = bins.ravel(), 1 / np.sqrt(k)
    return Features(start, index, value)


@dataclass
class Machine:
    """Bias, weights and vectors; scores are the logistic of bias + linear sum + pair sum."""
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def logits(self, f: Features) -> np.ndarray:
        rows = f.start[:-1]
        terms = self.vector[f.index] * f.value[:, None]
        linear = np.add.reduceat(self.weight[f.index] * f.value, rows)
        whole = np.add.reduceat(terms, rows, axis=0)
        squares = np.add.reduceat(terms * terms, rows, axis=0)
        return self.bias + linear + 0.5 * (whole * whole - squares).sum(axis=1)

    def scores(self, f: Features) -> np.ndarray:
        if len(f.start) == 1:
            return np.zeros(0)
        z = np.clip(self.logits(f).astype(np.float64), -30, 30)
        return 1 / (1 + np.exp(-z))


def fitted(f: Features, label: np.ndarray, seed: int = 0) -> Machine:
    """Log loss by adaptive gradient steps over shuffled batches of rows."""
    rng = np.random.default_rng(seed)
    share = (label.sum() + 1) / (len(label) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32),
                rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    if len(np.unique(label)) < 2:
        m.vector[:] = 0
        return m
    past_w, past_v = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    length = np.diff(f.start)
    for _ in range(max(1, -(-STEPS * BATCH // len(label)))):
        order = rng.permutation(len(label))
        for b in range(0, len(order), BATCH):
            rows = order[b:b + BATCH]
            n = length[rows]
            start = np.concatenate(([0], np.cumsum(n)))
            where = np.repeat(f.start[rows] - start[:-1], n) + np.arange(start[-1])
            part = Features(start, f.index[where], f.value[where])
            error = (m.scores(part) - label[rows]).astype(np.float32) / len(rows)
            owner = np.repeat(np.arange(len(rows)), n)
            g = error[owner] * part.value
            terms = m.vector[part.index] * part.value[:, None]
            whole = np.add.reduceat(terms, start[:-1], axis=0)
            gv = g[:, None] * (whole[owner] - terms)
            by = np.argsort(part.index, kind="stable")
            sorted_ = part.index[by]
            cut = np.flatnonzero(np.diff(sorted_, prepend=-1))
            at = sorted_[cut]
            gw = np.add.reduceat(g[by], cut) + DECAY * m.weight[at]
            gv = np.add.reduceat(gv[by], cut, axis=0) + DECAY * m.vector[at]
            past_w[at] += gw * gw
            past_v[at] += gv * gv
            m.weight[at] -= RATE * gw / np.sqrt(past_w[at])
            m.vector[at] -= RATE * gv / np.sqrt(past_v[at])
            m.bias -= 0.1 * float(error.sum())
    return m


def held_out(id_: Column) -> Column:
    """Whether the remainder of crc32 of the id as text by 5 is 0; NULL is the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces_of(batch, "text", SLICE_BYTES):
            f = features(*flat_utf8(part.column("text")))
            offsets = pa.array(f.start, pa.int32())
            yield pa.record_batch({
                "quality": part.column("quality"),
                "index": pa.ListArray.from_arrays(offsets, pa.array(f.index)),
                "value": pa.ListArray.from_arrays(offsets, pa.array(f.value))})


def learned(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
            label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """The model of rows that are labelled and not held out.

    Labels that repeat for an id are averaged (1 from 0.5 on); NULL ids and labels are left out.
    No more than about ``sample`` labels, the ones with the smallest hashes, are used.
    """
    of = (labels.select(F.col(f"`{label_id}`").alias("of"),
                        F.col(f"`{label_col}`").cast("double").alias("quality"))
          .filter("of IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("of")))
          .groupBy("of").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")))
    of = written(of, "labels")
    share = min(1.0, sample / max(of.count(), 1))
    chosen = written(of.filter(F.pmod(F.xxhash64("of"), F.lit(1 << 30)) < share * (1 << 30)),
                     "chosen")
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
            .join(chosen, F.col("id") == F.col("of")).select("quality", "text")
            .mapInArrow(_feature_rows, "quality int, index array<int>, value array<float>"))
    got = rows.toArrow()
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    label = got.column("quality").to_numpy()
    if not len(label):
        return fitted(Features(np.zeros(1, np.int64), np.zeros(0, np.int32),
                               np.zeros(0, np.float32)), np.zeros(0))
    size = index.value_lengths().to_numpy()
    index, value = index.flatten().to_numpy(), value.flatten().to_numpy()
    # the same order however the rows arrived, so that reruns agree
    start = np.concatenate(([0], np.cumsum(size)))
    key = np.add.reduceat(index.astype(np.int64) * 2654435761 % 1000003, start[:-1])
    order = np.lexsort((label, key, size))
    where = np.concatenate([np.arange(start[i], start[i + 1]) for i in order])
    return fitted(Features(np.concatenate(([0], np.cumsum(size[order]))), index[where],
                           value[where]), label[order].astype(np.float64))


def scorer(model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = flat_utf8(texts)
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            out.append(model.value.scores(features(data[offsets[at]:offsets[to]],
                                                   offsets[at:to + 1] - offsets[at])))
            at = to
        return pa.array(np.concatenate(out))
    return score


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           threshold: float = 0.3, sample: int = SAMPLE, **names) -> DataFrame:
    """(row, held_out, score, predicted) for each row of ``docs``.

    Scores are from the text alone. A NULL text is empty and is scored like one; without labels,
    or with labels of one kind only, all texts have the share of label 1 as score. ``row``
    holds all columns of ``docs``, of which others may be NULL. An empty table gives no rows.
    """
    model = learned(docs, labels, text_col, id_col, sample=sample, **names)
    score = scorer(docs.sparkSession.sparkContext.broadcast(model))
    rows = packed(docs).select("row", held_out(F.col(f"row.`{id_col}`")).alias("held_out"),
                               score(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
                               .alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
