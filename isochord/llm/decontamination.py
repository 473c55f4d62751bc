"""Occurrences of benchmark windows in documents, by a prefix-filtered set join.

A window is ``window`` consecutive words of an item, or a whole shorter item, seen as the set of
its shingles in their places. A document holds the window only if it holds every shingle of it,
so one shingle is the necessary prefix, and the rarest one is taken: shingles are counted over all
documents first. Documents then meet the prefix shingles, the places of which give the only
possible start; starts that leave the document at either end are refused, and the rest is
verified word by word and byte by byte.

Documents are read twice and never shuffled. The items reach the tasks in blocks of at most
``block`` pairs of item and window, each block a pass of its own; however large the benchmark
is, no more than one block is ever on the driver or broadcast. A passage that a third of all
documents hold costs these documents their own verification only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochord.llm.rows import flat_utf8, packed, pieces_of
from isochord.llm.words import ALNUM, LOWER, shingle_hashes, span_hashes, word_spans
from isochord.session import written

SHINGLE = 5
SLICE_BYTES = 1 << 20
#: Pairs of item and window (at most ten words) that are broadcast at once.
BLOCK = 200_000
FOUND = "n_words long, n_hit long, runs array<int>, items array<string>"


@dataclass
class Words:
    """Words of a slice of texts."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    per_doc: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, offsets = flat_utf8(texts)
        data = LOWER[data]
        starts, ends, doc = word_spans(data, offsets, ALNUM)
        return cls(data, starts, ends, doc, span_hashes(data, starts, ends),
                   np.bincount(doc, minlength=len(texts)).astype(np.int64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of shingles inside one document."""
        h = shingle_hashes(self.hashes, width)
        inside = self.doc[:len(h)] == self.doc[width - 1:width - 1 + len(h)]
        at = np.flatnonzero(inside)
        return at, h[at]

    def joined(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in
                         zip(self.starts[at:at + n].tolist(), self.ends[at:at + n].tolist()))


class Members:
    """Membership in a set of hashes: a bit map of their leading bits, then the sorted set."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.map = np.zeros(1 << 20, bool)
        self.map[self.sorted >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in ``hashes``, where in the set) of the members."""
        at = np.flatnonzero(self.map[hashes >> np.uint64(44)])
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        return at[hit], place[hit]


def _width(n_words: int) -> int:
    return min(n_words, SHINGLE)


def _window_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", SLICE_BYTES):
                w, items, texts = Words.of(part.column("text")), [], []
                heads = np.cumsum(w.per_doc) - w.per_doc
                for item, head, n in zip(part.column("item").to_pylist(), heads.tolist(),
                                         w.per_doc.tolist()):
                    size = min(window, n)
                    for at in range(head, head + n - size + 1 if n else head):
                        items.append(item)
                        texts.append(w.joined(at, size).decode())
                yield pa.record_batch({"item": pa.array(items, pa.string()),
                                       "words": pa.array(texts, pa.string())})
    return rows


def item_windows(items: DataFrame, text_col: str = "text", id_col: str = "item_id",
                 window: int = 10) -> DataFrame:
    """Distinct (item, words): the windows of each item, words joined by spaces.

    A NULL or wordless text has none; an item shorter than the window is one window.
    """
    flat = items.select(F.col(f"`{id_col}`").cast("string").alias("item"),
                        F.col(f"`{text_col}`").alias("text"))
    return flat.mapInArrow(_window_rows(window), "item string, words string").distinct()


class Windows:
    """The distinct windows of one block and their shingles."""

    def __init__(self, pairs: list[tuple[str | None, str]]):
        self.items: dict[str, set[str]] = defaultdict(set)
        for item, words in pairs:
            self.items[words] |= {item} - {None}
        self.texts = sorted(self.items)
        w = Words.of(pa.array(self.texts, pa.string()))
        self.sizes, self.hashes = w.per_doc, w.hashes
        self.heads = np.cumsum(w.per_doc) - w.per_doc
        at, owner, shingle = [], [], []
        for width in sorted({_width(n) for n in w.per_doc.tolist()}):
            place, h = w.shingles(width)
            mine = np.minimum(self.sizes[w.doc[place]], SHINGLE) == width
            at.append(place[mine] - self.heads[w.doc[place[mine]]])
            owner.append(w.doc[place[mine]])
            shingle.append(h[mine])
        none = np.zeros(0, np.int64)
        self.at = np.concatenate([none, *at])
        self.owner = np.concatenate([none, *owner])
        self.shingle = np.concatenate([none.astype(np.uint64), *shingle])
        self.widths = sorted({_width(n) for n in w.per_doc.tolist()})


def _shingle_counts(windows):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Windows = windows.value
        members = Members(mine.shingle)
        total = np.zeros(len(members.sorted), np.int64)
        for batch in batches:
            for part in pieces_of(batch, "text", SLICE_BYTES):
                w = Words.of(part.column("text"))
                for width in mine.widths:
                    _, place = members.find(w.shingles(width)[1])
                    total += np.bincount(place, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"shingle": members.sorted[seen].view(np.int64), "n": total[seen]})
    return counts


class Prefixes:
    """Each window under its rarest shingle: what a document is joined with."""

    def __init__(self, windows: Windows, counts: dict[int, int]):
        self.windows = windows
        n = np.array([counts.get(h, 0) for h in windows.shingle.view(np.int64).tolist()], np.int64)
        order = np.lexsort((windows.shingle, n, windows.owner))
        first = order[np.flatnonzero(np.diff(windows.owner[order], prepend=-1))]
        first = first[np.argsort(windows.shingle[first], kind="stable")]
        self.owner, self.at = windows.owner[first], windows.at[first]
        self.members = Members(windows.shingle[first])
        self.cuts = np.searchsorted(windows.shingle[first], self.members.sorted)
        self.many = np.diff(np.append(self.cuts, len(first)))

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the slice."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        head = np.cumsum(w.per_doc) - w.per_doc
        for width in self.windows.widths:
            at, h = w.shingles(width)
            where, place = self.members.find(h)
            rows = np.repeat(np.arange(len(where)), self.many[place])
            turn = np.arange(len(rows)) - np.repeat(
                np.cumsum(self.many[place]) - self.many[place], self.many[place])
            entry = self.cuts[place][rows] + turn
            pos, window = at[where][rows], self.owner[entry]
            start, size = pos - self.at[entry], self.windows.sizes[window]
            doc = w.doc[pos]
            # bounds of position and length
            ok = ((np.minimum(size, SHINGLE) == width) & (start >= head[doc])
                  & (start + size <= head[doc] + w.per_doc[doc]))
            start, window, size = start[ok], window[ok], size[ok]
            for k in range(int(size.max(initial=0))):
                same = (k >= size) | (
                    w.hashes[np.minimum(start + k, len(w.hashes) - 1)] == self.windows.hashes[
                        np.minimum(self.windows.heads[window] + k, len(self.windows.hashes) - 1)])
                start, window, size = start[same], window[same], size[same]
            exact = np.fromiter((w.joined(s, n) == self.windows.texts[i].encode() for s, n, i in
                                 zip(start.tolist(), size.tolist(), window.tolist())),
                                bool, len(start))
            starts.append(start[exact])
            found.append(window[exact])
        return np.concatenate(starts), np.concatenate(found)


def _finder(prefixes):
    def one(part: pa.Array, before: pa.Array | None) -> pa.Array:
        index: Prefixes = prefixes.value
        w = Words.of(part)
        head = np.cumsum(w.per_doc) - w.per_doc
        starts, found = index.occurrences(w)
        cover = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + index.windows.sizes[found], -1)
        names: dict[int, set[str]] = defaultdict(set)
        doc = w.doc[starts] if len(starts) else starts
        pairs = np.unique(doc * (len(index.windows.texts) + 1) + found)
        for p in pairs.tolist():
            d, i = divmod(p, len(index.windows.texts) + 1)
            names[d] |= index.windows.items[index.windows.texts[i]]
        if before is not None:
            for d, row in enumerate(before.to_pylist()):
                names[d] |= set(row["items"])
                for a, b in zip(row["runs"][::2], row["runs"][1::2]):
                    cover[head[d] + a] += 1
                    cover[head[d] + b] -= 1
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(hit) + 1, bool)
        edge[np.concatenate((head[w.per_doc > 0], [len(hit)])).astype(np.int64)] = True
        edge[1:-1] |= hit[1:] != hit[:-1]
        cuts = np.flatnonzero(edge)
        begins, ends = cuts[:-1], cuts[1:]
        full = hit[begins] if len(begins) else np.zeros(0, bool)
        begins, ends = begins[full], ends[full]
        own = w.doc[begins] if len(begins) else begins
        runs = np.stack((begins - head[own], ends - head[own]), 1).ravel() if len(begins) else begins
        run_off = np.concatenate(([0], np.cumsum(2 * np.bincount(own, minlength=len(part)))))
        n_hit = np.bincount(own, ends - begins, minlength=len(part)).astype(np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(w.per_doc), pa.array(n_hit),
             pa.ListArray.from_arrays(pa.array(run_off, pa.int32()), pa.array(runs, pa.int32())),
             pa.array([sorted(names.get(d, ())) for d in range(len(part))],
                      pa.list_(pa.string()))],
            names=["n_words", "n_hit", "runs", "items"])

    def sliced(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        _, offsets = flat_utf8(texts)
        out, at = [], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            out.append(one(texts.slice(at, to - at), before and before.slice(at, to - at)))
            at = to
        return pa.concat_arrays(out) if out else one(texts, before)

    @F.arrow_udf(FOUND)
    def first(texts: pa.Array) -> pa.Array:
        return sliced(texts, None)

    @F.arrow_udf(FOUND)
    def more(texts: pa.Array, before: pa.Array) -> pa.Array:
        return sliced(texts, before)
    return first, more


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  block: int = BLOCK) -> DataFrame:
    """(row, n_words, n_hit, runs, items) for each row of ``docs``.

    ``runs`` are the maximal runs of hit words as (first, end) in turn, ``items`` the sorted ids
    (as strings) of items with an occurring window. A NULL text has no words and no hits. An item
    without words has no window; an item with a NULL id marks words but is not listed; items
    with one id are one item. ``row`` holds all columns of ``docs``, of which others may be NULL.
    Empty tables of documents give no rows, of items no hits.
    """
    spark = docs.sparkSession
    pairs = written(item_windows(items, item_text, item_id, window), "windows")
    n_blocks = max(1, -(-pairs.count() // block))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    out = packed(docs).select("row", F.col(f"row.`{text_col}`").cast("string").alias("text"))
    for b in range(n_blocks):
        windows = Windows([(r.item, r.words) for r in
                           pairs.filter(F.col("block") == b).select("item", "words").collect()])
        counts = (texts.mapInArrow(_shingle_counts(spark.sparkContext.broadcast(windows)),
                                   "shingle long, n long")
                  .groupBy("shingle").agg(F.sum("n").alias("n")).collect())
        prefixes = Prefixes(windows, {r.shingle: r.n for r in counts})
        first, more = _finder(spark.sparkContext.broadcast(prefixes))
        found = first("text") if b == 0 else more("text", "found")
        out = out.select("row", "text", found.alias("found"))
    return out.select("row", "found.*")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    return contamination(docs, items, **options).filter("n_hit = 0").select("row.*")
