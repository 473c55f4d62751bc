"""Documents packed into as few fixed-length sequences as possible, with certified counts.

Pieces (documents, or parts of documents longer than a sequence) are dealt to partitions of
bounded size. Each partition is packed by best-fit decreasing and compared with a lower bound on
its number of bins, the largest that a family of dual feasible functions gives. A partition that
meets its bound is certified and done. Partitions with a gap keep their full bins and exchange
the documents of the others: these are dealt anew, to fewer partitions, and packed again, as are
the emptiest bins of certified partitions while the whole is above its own bound. Rounds end when
the bound is met, when a round saves nothing, or when all that is open went through one partition.

Only counts and a histogram of lengths (one row for each length) reach the driver.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.rows import flat_utf8, packed
from isochord.llm.token_counts import Tokenizer, byte_letters, word_bounds
from isochord.session import written

SLICE_BYTES = 1 << 20
#: Entries at which the tables of chunks and words start anew.
MOST_CHUNKS = 800_000
#: Pieces of one partition.
PART_ROWS = 1 << 15
#: Key of the end of a document; no chunk holds a space.
END = b" "


class Table(dict):
    """Token ids of byte strings: a key is given its place when first met and is then due to be
    filled; places are read all at once."""

    def __init__(self):
        super().__init__()
        self.due: list[bytes] = []
        self.store, self.bounds = array("I"), array("q", [0])

    def __missing__(self, key: bytes) -> int:
        self[key] = at = len(self)
        self.due.append(key)
        return at

    def places(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def fill(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the keys that are due, in a row, and how many each has."""
        self.bounds.frombytes((len(self.store) + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.store.frombytes(ids.astype(np.uint32).tobytes())
        self.due = []

    def sizes(self, places: np.ndarray) -> np.ndarray:
        bounds = np.frombuffer(self.bounds, np.int64)
        return bounds[places + 1] - bounds[places]

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of these places in a row."""
        size = self.sizes(places)
        begin = np.frombuffer(self.bounds, np.int64)[places]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.frombuffer(self.store, np.uint32)[at] if len(at) else np.zeros(0, np.uint32)


class Ids:
    """Token ids of texts by the tokenizer's library, asked once for each new word.

    No rule of the tokenizer looks across white space, so the ids of a text are those of its
    chunks between ASCII white space, and a chunk that was met before is looked up. New chunks are
    normalised and cut into words as ``token_counts`` does; the library merges the new words.
    Chunks that may hold a special string go through the whole of the library.
    """

    def __init__(self, source: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        self.splitter, self.end_id = Tokenizer(source), end_id
        self.whole = Library.from_str(source)
        self.whole.no_padding()
        self.whole.no_truncation()
        spec = json.loads(source)
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        #: ids that end a word
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # the merges alone, over words of byte letters between spaces
        self.merges = Library.from_str(json.dumps({
            **spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"},
            "added_tokens": [], "post_processor": None, "decoder": None, "truncation": None,
            "padding": None}))
        # no word holds a space, so that it can stand between them
        self.letters = {b: c for b, c in enumerate(byte_letters()) if b != 0x20}
        self.restart()

    def restart(self) -> None:
        self.words, self.chunks = Table(), Table()
        self.chunks.places([END])
        self.chunks.fill(np.array([self.end_id]), np.array([1]))

    def _learn_words(self) -> None:
        text = b" ".join(self.words.due).decode("latin-1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                       np.int64)
        self.words.fill(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))

    def _learn_chunks(self) -> None:
        due = self.chunks.due
        special = [i for i, c in enumerate(due) if b"<|" in c]
        text = self.splitter.normalised(
            b"\n".join([b"" if b"<|" in c else c for c in due] + [b""]).decode())[0]
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_bounds(self.splitter.symbols(text, data))
        at = self.words.places([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        if self.words.due:
            self._learn_words()
        owner = np.searchsorted(np.flatnonzero(data == 10), starts)
        sizes = np.bincount(owner, self.words.sizes(at), minlength=len(due)).astype(np.int64)
        ids = self.words.ids(at)
        if special:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in special:
                parts[i] = np.array(self.whole.encode(due[i].decode(),
                                                      add_special_tokens=False).ids, np.uint32)
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        self.chunks.fill(ids, sizes)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text in it); every text ends with the end id."""
        if len(self.chunks) > MOST_CHUNKS or len(self.words) > MOST_CHUNKS \
                or len(self.chunks.store) > 8 * MOST_CHUNKS:
            self.restart()
        chunks, ends = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            # A to Z are lowered in any case, but for special strings
            chunks += (text if b"<|" in text else text.lower()).split()
            chunks.append(END)
            ends[i] = len(chunks)
        at = self.chunks.places(chunks)
        if self.chunks.due:
            self._learn_chunks()
        to = np.cumsum(self.chunks.sizes(at))
        return self.chunks.ids(at), to[ends - 1]


def cut(flat: np.ndarray, ends: np.ndarray, limit: int) -> pa.Array:
    """Lists of (piece, start, length, ids) of each text; ids are little-endian 32-bit."""
    n = np.diff(ends, prepend=0)
    pieces = -(-n // limit)
    to = np.cumsum(pieces)
    owner = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(int(pieces.sum())) - (to - pieces)[owner]
    start = piece * limit
    length = np.minimum(n[owner] - start, limit)
    bounds = np.concatenate(([0], np.cumsum(length))) * 4
    ids = pa.Array.from_buffers(pa.large_binary(), len(length), [
        None, pa.py_buffer(bounds.astype(np.int64).tobytes()),
        pa.py_buffer(flat.astype("<u4").tobytes())])
    made = pa.StructArray.from_arrays(
        [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
         ids.cast(pa.binary())], ["piece", "start", "length", "ids"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to)), pa.int32()), made)


@lru_cache(2)
def _ids(source: str, end_id: int) -> Ids:
    return Ids(source, end_id)


def pieces(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0,
           text_col: str = "text") -> DataFrame:
    """(row, piece, start, length, ids) for each piece of each row of ``docs``.

    A document is the ids of its text, without added special tokens, and ``end_id``. Only one of
    more than ``limit`` ids is cut, into pieces of ``limit`` and a rest. A NULL or empty text is
    the end id alone. ids are binary, four little-endian bytes each. ``row`` holds all columns of
    ``docs``; rows that repeat are cut alike. The tokenizer file at ``path`` is read on the driver
    once; its size is that of the vocabulary.
    """
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids:binary>>")
    def piece_lists(texts: pa.Array) -> pa.Array:
        own = _ids(source.value, end_id)
        data, offsets = flat_utf8(texts)
        out, at = [], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            raw, cuts = data[offsets[at]:offsets[to]].tobytes(), offsets[at:to + 1] - offsets[at]
            out.append(cut(*own.of([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]), limit))
            at = to
        return pa.concat_arrays(out) if out else cut(
            np.zeros(0, np.uint32), np.zeros(0, np.int64), limit)

    rows = packed(docs).select("row", piece_lists(F.col(f"row.`{text_col}`")).alias("made"))
    # no text has an empty list; the outer form keeps Spark from testing that by a second pass
    return rows.select("row", F.inline_outer("made"))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: from the longest on, each goes to the fullest bin that has
    room. Equal lengths are placed together, so a step is one of (length, room), not of pieces."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[int] = []
    having: dict[int, list[int]] = {}
    n_bins = done = 0

    def put(members: list[int], room: int, size: int, each: int, count: int) -> None:
        """``count`` pieces to these bins, ``each`` to one, the rest to the last."""
        nonlocal done
        items = order[done:done + count]
        bins[items] = np.repeat(members, each)[:count]
        offsets[items] = capacity - room + np.tile(np.arange(each), len(members))[:count] * size
        done += count
        rest = count - (len(members) - 1) * each
        for left, who in ((room - each * size, members[:-1]), (room - rest * size, members[-1:])):
            if left and who:
                if left not in having:
                    having[left] = []
                    insort(rooms, left)
                having[left] += who
    sizes, counts = np.unique(lengths, return_counts=True)
    for size, count in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
        while count:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                break
            room = rooms[i]
            each = room // size
            here = having[room]
            take = min(len(here), -(-count // each))
            members = here[-take:]
            del here[-take:]
            if not here:
                del having[room]
                rooms.pop(i)
            put(members, room, size, each, min(count, take * each))
            count -= min(count, take * each)
        if count:
            each = capacity // size
            new = -(-count // each)
            put(list(range(n_bins, n_bins + new)), capacity, size, each, count)
            n_bins += new
    return bins, offsets


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing of these lengths has fewer bins.

    The largest bound of three families of dual feasible functions f (sums of f over one bin stay
    within 1): thresholds that round long pieces up and drop short ones, rounding by multiples of
    1/(k+1), and shares of the room that a piece beyond the half leaves; and the first two one
    after the other. All in integers.
    """
    v, n = sizes.astype(np.int64), counts.astype(np.int64)
    if not len(v):
        return 0
    half = np.unique(np.concatenate(([0], v[2 * v <= capacity], (capacity - v)[2 * v > capacity])))
    lam = half[:, None]
    raised = np.where(v > capacity - lam, capacity, np.where(v < lam, 0, v))
    best = -(-int((raised @ n).max()) // capacity)
    for k in range(1, 12):
        up = raised * (k + 1)
        f = np.where(up % capacity == 0, raised * k, up // capacity * capacity)
        best = max(best, -(-int((f @ n).max()) // (k * capacity)))
    eps = half[half > 0][:, None]
    if len(eps):
        q = capacity // eps
        f = np.where(2 * v > capacity, q - (capacity - v) // eps, (v >= eps).astype(np.int64))
        best = max(best, int((-(-(f @ n) // q[:, 0])).max()))
    return best


#: Columns that a round adds: place of a piece, fill of its bin, figures of its partition.
PLACE = "part long, bin long, offset long, fill long, emptiest boolean, bins long, bound long"


def _pack(capacity: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        sizes, counts = np.unique(lengths, return_counts=True)
        n = len(lengths)
        return pa.table({
            "piece": rows.column("piece"), "length": rows.column("length"),
            "part": np.full(n, key[0].as_py()), "bin": bins, "offset": offsets,
            "fill": fill[bins], "emptiest": bins == int(fill.argmin()),
            "bins": np.full(n, len(fill)),
            "bound": np.full(n, lower_bound(sizes, counts, capacity))})
    return pack


def _round(open_: DataFrame, parts: int, number: int, capacity: int, label: str) -> DataFrame:
    """The written places of (piece, length) dealt to ``parts`` partitions."""
    dealt = open_.select("piece", "length", F.pmod(
        F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(parts)).alias("part"))
    kind = f"piece {open_.schema['piece'].dataType.simpleString()}, length long, {PLACE}"
    return written(dealt.groupBy("part").applyInArrow(_pack(capacity), kind), label)


def _bins(rows: DataFrame) -> int:
    """Bins of placed rows: each has one piece at offset 0."""
    return rows.filter("offset = 0").count()


def placed(rows: DataFrame, limit: int = 2048, length_col: str = "length",
           part_rows: int = PART_ROWS) -> DataFrame:
    """(piece, sequence_id, offset): a place for each row of ``rows``, all columns of which are in
    the struct ``piece``.

    Lengths are 1 to ``limit``; others, and NULL, are an error. Rows may repeat: each is placed.
    Pieces as long as a sequence are one of their own and enter no partition. Sequences have no
    gaps. An empty table gives no rows.
    """
    length = F.col(f"piece.`{length_col}`").cast("long")
    fits = F.coalesce(length.between(1, limit), F.lit(False))
    # rows are numbered, for the deal, as they lie in the written table
    all_ = written(rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("piece"))
                   .select("piece", F.when(fits, length).otherwise(F.raise_error(
                       F.lit("the length of a piece is not within a sequence"))).cast("long")
                       .alias("length")), "pieces")
    whole = all_.filter(F.col("length") == limit).select(
        "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    open_ = all_.filter(F.col("length") < limit)
    counts = np.array(open_.groupBy("length").count().collect(), np.int64).reshape(-1, 2)
    # one row for each length: the bound of the whole
    target = lower_bound(counts[:, 0], counts[:, 1], limit)
    n, number, closed = int(counts[:, 1].sum()), 0, []
    parts = max(-(-n // part_rows), 1)
    now = _round(open_, parts, number, limit, "packed")
    saved_bins = _bins(now)
    total = saved_bins
    while total > target and parts > 1:
        loose = (F.col("fill") < limit) & ((F.col("bins") > F.col("bound")) | F.col("emptiest"))
        again = now.filter(loose)
        before, rows_again = _bins(again), again.count()
        parts = max(min(-(-rows_again // part_rows), parts - 1), 1)
        new = _round(again, parts, number + 1, limit, "packed")
        after = _bins(new)
        if after >= before:
            break
        closed.append((number, now.filter(~loose)))
        now, number, total = new, number + 1, total - before + after
    closed.append((number, now))
    for number, part in closed:
        # 6 bits of the round, 28 of the partition, 28 of the bin
        whole = whole.union(part.select("piece", (
            F.lit(number << 56) + F.col("part") * F.lit(1 << 28) + F.col("bin"))
            .alias("sequence_id"), "offset"))
    return whole


def sequences(places: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from places of pieces that have their ids.

    At most as many pieces as a sequence has ids meet in one group.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col("piece.ids").alias("ids"))))
    return places.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
        .alias("ids"))


def packed_documents(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0,
                     text_col: str = "text") -> DataFrame:
    """(sequence_id, ids) of all documents of ``docs``, ready for training; ids as in ``pieces``."""
    return sequences(placed(pieces(docs, path, limit, end_id, text_col).select("length", "ids"),
                            limit))
