"""Long byte strings that occur more than once are removed, by a sparse suffix array on Spark.

Sorting every suffix would move each text some two hundred times. Instead suffixes begin at
anchors that depend on the text around them only: each window of ``length`` bytes has the
leftmost smallest hash among its ``TOKEN``-byte tokens as its anchor, so equal windows have the
same anchor at the same place. Windows in a row with one anchor form a *piece*, about one per
seventy bytes of text.

1. Pieces are range-partitioned by sampled splitters on their leading token (its hash, so that
   ranges are even), then their own hash and place, and sorted within partitions. What a piece
   has in common with others shows in its neighbours in that order: equal pieces are copies of
   each other, other pieces of the anchor are still to be compared. The first and last row of
   each partition meet their neighbours across the boundary afterwards (two rows a partition).
   Splitters cut through groups, so an anchor or a piece with a third of all rows spreads.
2. Only pieces that share an anchor but differ are given their bytes. Buckets, again by range of
   anchor, sort the windows by a multikey quicksort, eight bytes at a time and only among those
   that tie so far. Pieces of an anchor with more than ``CROWD`` of them are parted by a
   longer token first; where as many share even that, their windows are counted by digest, each
   on its own, wherever it hashes to.
3. The marked windows return to their documents as byte ranges.

Anchors and pieces are 64-bit hashes that act together with each other and with the place in
the window; windows are compared byte by byte, or by 128-bit digests if crowded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochord.llm.rows import digest128, flat_utf8, pieces_of
from isochord.llm.words import running_hashes
from isochord.session import written

TOKEN = 50
SLICE_BYTES = 1 << 20
#: Differing pieces of one anchor that a bucket compares by itself.
CROWD = 2048
#: Pieces whose windows are sorted at once.
BUCKET_PIECES = 4096
COPY, OPEN, EDGE = 1, 2, 4
PIECE = "anchor long, piece long, k1 long, k2 long, place long"
MARKED = PIECE + ", mark int"
_KEY = ("anchor", "piece", "k1", "k2", "place")
RANGES = "k1 long, k2 long, lo long, hi long"


def leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its smallest, the leftmost of equals."""
    value, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        at = np.where(later, at[step:], at[:-step])
        size += step
    return at


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, token: int
           ) -> tuple[np.ndarray, ...]:
    """(document, place, anchor hash, piece hash) of every piece.

    A place packs the first window, the number of windows less one, and how far behind the first
    window the anchor lies; the last two take a byte each.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    spans = running_hashes(data)
    starts = np.arange(len(data) - token + 1)
    tokens = spans(starts, starts + token)
    at = leftmost_smallest(tokens, length - token + 1)
    windows = np.arange(len(at))
    doc = np.searchsorted(offsets, windows, "right") - 1
    inside = windows + length <= offsets[doc + 1]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    first, count = first[inside[first]], count[inside[first]]
    own = doc[first]
    place = (first - offsets[own]) << 16 | (count - 1) << 8 | (at[first] - first).astype(np.int64)
    return (own, place, tokens[at[first]].view(np.int64),
            spans(first, first + count - 1 + length).view(np.int64))


def unpacked(place):
    """(first window, windows, anchor's distance) of places: numpy arrays."""
    return place >> 16, (place >> 8 & 255) + 1, place & 255


def _piece_rows(length: int, token: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", SLICE_BYTES):
                data, offsets = flat_utf8(part.column("text"))
                doc, place, anchor, piece = pieces(data, offsets, length, token)
                doc = pa.array(doc)
                yield pa.record_batch({
                    "anchor": anchor, "piece": piece, "k1": part.column("k1").take(doc),
                    "k2": part.column("k2").take(doc), "place": place})
    return rows


def _marks(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """COPY and OPEN of sorted rows from the neighbours they have here: equal pieces, and other
    pieces of the anchor next to the first or last of equal ones."""
    anchor, piece = rows[0], rows[1]
    same_anchor = anchor[1:] == anchor[:-1]
    same_piece = same_anchor & (piece[1:] == piece[:-1])
    off = np.zeros(1, bool)
    copy = np.concatenate((off, same_piece)) | np.concatenate((same_piece, off))
    other = same_anchor & ~same_piece
    return copy, np.concatenate((off, other)) | np.concatenate((other, off))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted pieces; a partition's first and last row also carry EDGE."""
    held: list[np.ndarray] | None = None  # the last two rows of the batch before
    begun = False

    def emit(rows, mark, which):
        keep = np.flatnonzero(which & (mark > 0))
        return pa.record_batch({c: r[keep] for c, r in zip(_KEY, rows)}
                               | {"mark": mark[keep].astype(np.int32)})
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy() for i in range(5)]
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        n = len(rows[0])
        copy, open_ = _marks(rows)
        mark = copy * COPY + open_ * OPEN
        which = np.ones(n, bool)
        which[-1] = False               # its next neighbour is still to come
        if begun and n > 1:
            which[0] = n - len(new[0]) < 2  # only there as a neighbour
        if not begun and n > 1:
            mark[0] |= EDGE
            begun = True
        yield emit(rows, mark, which)
        held = [r[-2:] for r in rows]
    if held is not None:
        copy, open_ = _marks(held)
        mark = (copy * COPY + open_ * OPEN) | EDGE
        which = np.zeros(len(mark), bool)
        which[-1] = True
        yield emit(held, mark, which)


def marked_pieces(texts: DataFrame, length: int, token: int) -> DataFrame:
    """(anchor, piece, k1, k2, place, mark) of pieces that have copies (COPY) or share their
    anchor with others (OPEN), as a table, from rows of (k1, k2, text)."""
    spark = texts.sparkSession
    ordered = (texts.mapInArrow(_piece_rows(length, token), PIECE)
               .repartitionByRange(*_KEY).sortWithinPartitions(*_KEY))
    found = written(ordered.mapInArrow(_neighbours, MARKED), "marked")
    # two rows a partition, in the order of the whole
    edges = [tuple(r) for r in found.filter(F.col("mark").bitwiseAND(EDGE) != 0).orderBy(*_KEY)
             .collect()]
    if edges:
        copy, open_ = _marks([np.array(c) for c in zip(*(r[:2] for r in edges))])
        edges = [(*r[:5], (r[5] & ~EDGE) | int(c) * COPY | int(o) * OPEN)
                 for r, c, o in zip(edges, copy, open_)]
    inner = found.filter(F.col("mark").bitwiseAND(EDGE) == 0)
    return inner.union(spark.createDataFrame([e for e in edges if e[5]], MARKED))


def _big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that orders like them."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(
        ">u8").ravel()[:len(data) + 1].astype(np.uint64)


def tied_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int
                 ) -> np.ndarray:
    """Which windows (of ``length`` bytes from ``starts``) equal another one of their group.

    A multikey quicksort taken level by level: windows are ordered by one token of eight bytes,
    and only those that tie go on to the next.
    """
    tokens = _big_endian(data)
    live = np.arange(len(starts))
    depths = [*range(0, length - 7, 8)]
    if length % 8:
        depths.append(max(length - 8, 0))
    for depth in [None, *depths]:
        if len(live) < 2:
            break
        token = tokens[starts[live] + depth] if depth is not None else np.zeros(len(live),
                                                                               np.uint64)
        if length < 8 and depth is not None:
            token = token >> np.uint64(8 * (8 - length))
        order = np.lexsort((token, group[live]))
        live, token = live[order], token[order]
        same = (group[live][1:] == group[live][:-1]) & (token[1:] == token[:-1])
        off = np.zeros(1, bool)
        tied = np.concatenate((off, same)) | np.concatenate((same, off))
        number = np.cumsum(~np.concatenate((off, same)))
        live, number = live[tied], number[tied]
        group = group.copy()
        group[live] = number
    out = np.zeros(len(starts), bool)
    out[live] = len(live) > 1
    return out


def _resolve(length: int):
    def ranges(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = _flat_binary(rows.column("bytes").combine_chunks())
        lo, n, distance = unpacked(rows.column("place").to_numpy())
        _, anchor = np.unique(rows.column("anchor").to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        # equal windows have their anchor at the same place
        lead = distance[owner] - turn
        tied = tied_windows(data, offsets[owner] + turn, anchor[owner] * 512 + lead, length)
        tied &= ~rows.column("copy").to_numpy(zero_copy_only=False)[owner]
        at = np.flatnonzero(tied)
        begin = np.ones(len(at), bool)
        begin[1:] = (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
        first = at[begin]
        last = at[np.append(np.flatnonzero(begin)[1:] - 1, len(at) - 1)] if len(at) else at
        own = pa.array(owner[first])
        return pa.record_batch({
            "k1": rows.column("k1").combine_chunks().take(own),
            "k2": rows.column("k2").combine_chunks().take(own),
            "lo": lo[owner[first]] + turn[first], "hi": lo[owner[last]] + turn[last] + length})

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < BUCKET_PIECES:
                continue
            anchor = held.column("anchor").to_numpy()
            cut = int(np.flatnonzero(anchor == anchor[-1])[0])
            if cut:
                yield ranges(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield ranges(held)
    return buckets


def _flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _first(place: Column) -> Column:
    return F.shiftright(place, 16)


def _windows(place: Column) -> Column:
    return (F.shiftright(place, 8).bitwiseAND(255) + 1).cast("int")


def repeated_ranges(texts: DataFrame, length: int = 200, token: int = TOKEN,
                    crowd: int = CROWD) -> DataFrame:
    """(k1, k2, lo, hi): byte ranges covered by strings of ``length`` bytes that also start
    elsewhere, from rows of (k1, k2, text); ranges may overlap."""
    marked = marked_pieces(texts, length, token)
    lo, n = _first(F.col("place")), _windows(F.col("place"))
    copies = marked.filter(F.col("mark").bitwiseAND(COPY) != 0).select(
        "k1", "k2", lo.alias("lo"), (lo + n - 1 + length).alias("hi"))
    open_ = marked.filter(F.col("mark").bitwiseAND(OPEN) != 0)
    crowded = written(open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
                      .filter(F.col("n") > crowd).select("anchor"), "crowded")
    data = written(_with_bytes(texts, open_, length), "bytes")
    found = copies.unionByName(data.join(crowded, "anchor", "left_anti")
                               .repartition("anchor").sortWithinPartitions("anchor")
                               .mapInArrow(_resolve(length), RANGES))
    if crowded.isEmpty():
        return found
    many = data.join(crowded, "anchor", "left_semi")
    halves = _halves(many, length, token)
    size = written(halves.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("anchor", (F.col("n") > crowd).alias("crowded")),
                   "half-sizes")
    halves = halves.join(size, "anchor")
    found = found.unionByName(halves.filter("NOT crowded").drop("crowded")
                              .repartition("anchor").sortWithinPartitions("anchor")
                              .mapInArrow(_resolve(length), RANGES))
    if size.filter("crowded").isEmpty():
        return found
    return found.unionByName(_crowded_ranges(halves.filter("crowded"), length))


def _halves(data: DataFrame, length: int, token: int) -> DataFrame:
    """Pieces of crowded anchors, parted by a longer token.

    A window holds half of what it has beside its anchor on the left or on the right of it. The
    windows of a piece that do so on the left share the anchor with that left half, the others
    that with the right half; each part becomes a piece of its own under the longer anchor.
    """
    half = (length - token) // 2
    n, d = _windows(F.col("place")), F.col("place").bitwiseAND(255).cast("int")

    def part(side, first, last, at):
        key = F.substring("bytes", at + 1, F.lit(half + token))
        place = F.shiftleft(_first(F.col("place")) + first, 16).bitwiseOR(
            F.shiftleft((last - first).cast("long"), 8)).bitwiseOR((d - first).cast("long"))
        return F.when(first <= last, F.struct(
            F.xxhash64("anchor", F.lit(side), key).alias("anchor"), place.alias("place"),
            F.substring("bytes", first + 1, last - first + length).alias("bytes")))
    zero = F.lit(0)
    left = part(0, zero, F.least(n - 1, d - half), d - half)
    right = part(1, F.greatest(zero, d - half + 1), n - 1, d)
    return (data.select("k1", "k2", "copy", F.explode(F.array(left, right)).alias("part"))
            .filter("part IS NOT NULL")
            .select("k1", "k2", "copy", "part.anchor", "part.place", "part.bytes"))


def _with_bytes(texts: DataFrame, pieces_: DataFrame, length: int) -> DataFrame:
    """(k1, k2, anchor, place, copy, bytes) of marked pieces."""
    asked = pieces_.groupBy("k1", "k2").agg(F.collect_set(F.struct(
        "anchor", "place", (F.col("mark").bitwiseAND(COPY) != 0).alias("copy"))).alias("asked"))
    # rows that repeat have one key and one text: the first speaks for all
    one = texts.join(asked, ["k1", "k2"]).groupBy("k1", "k2").agg(
        F.first("text").alias("text"), F.first("asked").alias("asked"))
    place = F.col("of.place")
    return (one.select("k1", "k2", F.encode("text", "UTF-8").alias("data"),
                       F.explode("asked").alias("of"))
            .select("k1", "k2", "of.anchor", "of.place", "of.copy",
                    F.substring("data", (_first(place) + 1).cast("int"),
                                _windows(place) - 1 + length).alias("bytes")))


def _crowded_ranges(data: DataFrame, length: int) -> DataFrame:
    """The same for pieces of crowded anchors: each window counted by its digest."""
    lo, n = _first(F.col("place")), _windows(F.col("place"))
    window = F.substring("bytes", F.col("turn") + 1, F.lit(length))
    h1, h2 = digest128(window)
    windows = (data.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("turn"))
               .select("k1", "k2", "copy", (lo + F.col("turn")).alias("lo"), "anchor",
                       h1.alias("h1"), h2.alias("h2")))
    # a piece with copies may be there once: it stands for two
    many = written(windows.groupBy("anchor", "h1", "h2").agg(
        F.sum(F.when(F.col("copy"), 2).otherwise(1)).alias("n")).filter("n > 1")
        .select("anchor", "h1", "h2"), "crowded-windows")
    return (windows.filter("NOT copy").join(many, ["anchor", "h1", "h2"], "left_semi")
            .select("k1", "k2", "lo", (F.col("lo") + length).alias("hi")))


@F.arrow_udf(T.StructType([T.StructField("spans", T.ArrayType(T.LongType())),
                           T.StructField("kept", T.BinaryType())]))
def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Merges the ranges (lo, hi in turn) of each text and cuts them out."""
    spans, kept = [], []
    for text, own in zip(texts.to_pylist(), ranges.to_pylist()):
        data, merged = (text or "").encode(), []
        for lo, hi in sorted((r["lo"], r["hi"]) for r in own or ()):
            if merged and lo <= merged[-1]:
                merged[-1] = max(merged[-1], hi)
            else:
                merged += [lo, hi]
        at = [0, *merged, len(data)]
        spans.append(merged)
        kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2])))
    return pa.StructArray.from_arrays([pa.array(spans, pa.list_(pa.int64())),
                                       pa.array(kept, pa.binary())], names=["spans", "kept"])


def drop_repeated_strings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          length: int = 200, token: int = TOKEN, crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, spans, kept), one row for each row of ``docs``.

    ``spans`` are the maximal removed byte ranges (begin, end in turn) of the UTF-8 text: every
    byte covered by a string of ``length`` bytes that also starts anywhere else, overlaps and the
    same document included, judged on the input; matches never cross documents. ``kept`` are the
    remaining bytes, which need not be UTF-8. A NULL text is empty; texts shorter than ``length``
    lose nothing; rows that repeat lose all their long strings. Ids may be NULL or repeat; other
    columns are not read. An empty table gives no rows.
    """
    if not token < length <= token + 255:
        raise ValueError("length must exceed token by 1 to 255 bytes")
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    k1, k2 = digest128(id_, text)
    whole = F.coalesce(text, F.lit("")).alias("text")
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        # the id itself is half of the key and packs better than a digest; the last bit of k1
        # says whether it is NULL
        k1 = F.shiftleft(k1, 1).bitwiseOR(id_.isNull().cast("long"))
        texts = docs.select(k1.alias("k1"), F.coalesce(id_.cast("long"), F.lit(0)).alias("k2"),
                            whole)
        own = F.when(F.col("k1").bitwiseAND(1) == 0, F.col("k2")).alias("id")
    else:
        texts = docs.select(id_.alias("id"), k1.alias("k1"), k2.alias("k2"), whole)
        own = F.col("id")
    ranges = (repeated_ranges(texts, length, token, crowd).groupBy("k1", "k2")
              .agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    return (texts.join(ranges, ["k1", "k2"], "left")
            .select(own, F.octet_length("text").cast("long").alias("n_bytes"),
                    _cut("text", "ranges").alias("cut"))
            .select("id", "n_bytes", "cut.spans", "cut.kept"))
