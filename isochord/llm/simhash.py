"""SimHash fingerprints of word shingles, linked by a tiled exact comparison.

Fingerprints are made per document in numpy and folded to distinct values. Distinct values
are cut into blocks by their population count; a pair of blocks is a tile, and tiles whose
counts differ by more than the radius are never formed. Inside a tile both sides are ordered
by the counts of their four 16-bit lanes and cut into small tiles, which are skipped likewise
when their lanes' counts differ by more than the radius in sum; the rest is compared by
exclusive-or and bit counts. A tile returns a spanning forest of its links, at most one link
for each value, so groups of near copies never become pairs. The search is exact: its work
grows with the square of the distinct fingerprints, divided by what the counts exclude.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochord.llm.components import components, joined_roots
from isochord.llm.rows import digest128, flat_utf8, packed
from isochord.llm.words import LOWER as LOWER_CASE
from isochord.llm.words import NOT_SPACE, mixed, shingle_hashes, span_hashes, word_spans
from isochord.session import written

#: Fingerprints of one side of a tile.
BLOCK = 32768
#: Fingerprints of one side of a small tile.
SMALL = 512
#: Wide fingerprints of one side of a tile: as many for large tables, fewer for smaller ones, which
#: are cut into up to so many blocks; and of one side of a small tile.
WIDE_BLOCK, WIDE_LEAST, WIDE_BLOCKS, WIDE_SMALL = 131072, 8192, 8, 512
#: Bytes of text taken at once, and shingles whose bits are counted at once.
SLICE_BYTES, SLICE_SHINGLES = 1 << 20, 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int
                  ) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, shingles per document): words joined by single spaces, and where the
    shingles lie in them. A document of fewer words than ``width`` has its whole sequence."""
    n = len(offsets) - 1
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1] if len(data) else word
    after = np.concatenate((word[1:], [False])) & ~edge[1:] if len(data) else word
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    length = ends - starts
    joined = np.full(int(length.sum()) + len(starts), 0x20, np.uint8)
    first = np.cumsum(length + 1) - length - 1
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(starts)), length)] = \
        _LOWER[data[word]]
    words = np.bincount(doc, minlength=n)
    head = np.cumsum(words) - words
    rank = np.arange(len(starts)) - head[doc]
    short = np.minimum(words, width)[doc]
    begins = rank + short <= words[doc]
    lead = np.flatnonzero(begins)
    last = lead + short[lead] - 1
    counts = np.where(words >= width, words - width + 1, (words > 0).astype(words.dtype))
    return joined.tobytes(), first[lead], first[last] + length[last], counts


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The 64-bit fingerprint of each text; 0 for a text without words."""
    text, starts, ends, counts = shingle_spans(data, offsets, width)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())),
                         np.uint64, len(starts))
    owner = np.repeat(np.arange(len(counts)), counts)
    ones = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), SLICE_SHINGLES):
        part, own = hashes[at:at + SLICE_SHINGLES], owner[at:at + SLICE_SHINGLES]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    over = 2 * ones > counts[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_udf(width: int, seed: int):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        data, offsets = flat_utf8(texts)
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            out.append(fingerprints(data[offsets[at]:offsets[to]],
                                    offsets[at:to + 1] - offsets[at], width, seed))
            at = to
        return pa.array(np.concatenate(out).view(np.int64))
    return fingerprint


def lane_counts(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit lanes of each value."""
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).astype(np.int16)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of values within ``radius`` bits, small tile by small tile.

    ``same``: a and b are one block; each unordered pair is then looked at once.
    """
    order_a = np.lexsort(lane_counts(a).T[::-1])
    order_b = order_a if same else np.lexsort(lane_counts(b).T[::-1])
    sa, sb = a[order_a], b[order_b]

    def boxes(values):
        cuts = np.arange(0, len(values), SMALL)
        lanes = lane_counts(values)
        return cuts, np.minimum.reduceat(lanes, cuts), np.maximum.reduceat(lanes, cuts)

    cuts_a, low_a, high_a = boxes(sa)
    cuts_b, low_b, high_b = boxes(sb)
    for i, at in enumerate(cuts_a):
        gap = np.maximum(np.maximum(low_a[i] - high_b, low_b - high_a[i]), 0).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            x = sa[at:at + SMALL, None] ^ sb[None, cuts_b[j]:cuts_b[j] + SMALL]
            p, q = np.nonzero(np.bitwise_count(x) <= radius)
            if len(p):
                yield order_a[at + p], order_b[cuts_b[j] + q]


def _tile_links(radius: int):
    def links(key: tuple, tile: pa.Table) -> pa.Table:
        values = tile.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        block = tile.column("block").to_numpy()
        left = values[block == key[0].as_py()]
        same = key[0] == key[1]
        right = left if same else values[block == key[1].as_py()]
        both = left if same else np.concatenate((left, right))
        shift = 0 if same else len(left)
        root = np.arange(len(both))
        if len(left) and len(right):
            for p, q in close_pairs(left, right, radius, same):
                root = joined_roots(root, p, q + shift)
        ends = np.flatnonzero(root != np.arange(len(root)))
        both = both.view(np.int64)
        return pa.table({"a": both[ends], "b": both[root[ends]]})
    return links


def close_links(values: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b) of each tile's links among distinct fingerprints ``fp``.

    ``block``: values of one side of a tile; more values of one population count make more
    blocks, never larger ones (their number is exact, so a block is filled by hash alone).
    """
    counted = values.withColumn("pop", F.bit_count("fp"))
    # at most 65 rows, whatever the input
    sizes = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    blocks = {p: -(-n // block) for p, n in sizes.items()}
    first = {p: sum(blocks[q] for q in blocks if q < p) for p in blocks}
    if not blocks:
        return values.sparkSession.createDataFrame([], "a long, b long")
    per_pop = F.create_map(*[F.lit(x) for p in blocks for x in (p, blocks[p])])
    head = F.create_map(*[F.lit(x) for p in blocks for x in (p, first[p])])
    reach = {p: [q for q in blocks if abs(q - p) <= radius] for p in blocks}
    span = F.create_map(*[x for p in blocks for x in (F.lit(p), F.array(
        F.lit(min(first[q] for q in reach[p])),
        F.lit(max(first[q] + blocks[q] for q in reach[p]) - 1)))])
    # populations are contiguous in block numbers, so the partners of a block are a range
    own = (counted.withColumn("block", head[F.col("pop")]
                              + F.pmod(F.xxhash64("fp"), per_pop[F.col("pop")]).cast("int"))
           .withColumn("span", span[F.col("pop")]))
    partner = F.explode(F.sequence(F.col("span")[0], F.col("span")[1])).alias("partner")
    return (own.select("fp", "block", partner)
            .select("fp", "block", F.least("block", "partner").alias("x"),
                    F.greatest("block", "partner").alias("y"))
            .groupBy("x", "y").applyInArrow(_tile_links(radius), "a long, b long"))


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, k1, k2, fingerprint, grp, component_id), one row for each row of ``docs``.

    ``fingerprint`` is a signed 64-bit value, ``component_id`` the smallest id of the group
    reachable by links of at most ``radius`` bits (NULL only if all its ids are NULL), k1 and k2
    a digest of id and text. Texts that are NULL or hold no word have fingerprint 0, which links
    like any other. Rows that repeat fall into one group. ``grp`` is the group's smallest
    fingerprint and names it also where ids are NULL or repeat. Other columns are not read. An
    empty table gives no rows.
    """
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    k1, k2 = digest128(id_, text)
    slim = written(docs.select(id_.alias("id"), k1.alias("k1"), k2.alias("k2"),
                               fingerprint_udf(width, seed)(text).alias("fp")), "prints")
    named = fingerprint_components(slim, radius)
    return (slim.join(named, "fp")
            .select("id", "k1", "k2", F.col("fp").alias("fingerprint"), "grp", "component_id"))


def fingerprint_components(slim: DataFrame, radius: int) -> DataFrame:
    """(fp, grp, component_id) for each distinct fingerprint of rows (id, fp)."""
    values = written(slim.groupBy("fp").agg(F.min("id").alias("first")), "values")
    linked = written(components(close_links(values.select("fp"), radius)), "linked")
    least = written(linked.join(values, F.col("node") == F.col("fp"))
                    .groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = (linked.join(least, "component")
             .select(F.col("node"), F.struct("component", "component_id").alias("of")))
    return written(values.join(named, F.col("node") == F.col("fp"), "left")
                   .select("fp", F.coalesce("of.component", "fp").alias("grp"),
                           F.when(F.col("of").isNull(), F.col("first"))
                           .otherwise(F.col("of.component_id")).alias("component_id")), "named")


def wide_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, lanes: int,
                      seed: int) -> np.ndarray:
    """[text, lane]: SimHash fingerprints of 64 bits a lane over shingles of ``width`` words,
    repeats included (fewer words: one shingle); A-Z lowered. Zeros for a text without words."""
    data = LOWER_CASE[data]
    starts, ends, doc = word_spans(data, offsets, NOT_SPACE)
    n_docs = len(offsets) - 1
    words = span_hashes(data, starts, ends)
    per_doc = np.bincount(doc, minlength=n_docs)
    head = np.cumsum(per_doc) - per_doc
    out = np.zeros((n_docs, lanes), np.uint64)
    hashes = shingle_hashes(words, width)
    lead = np.flatnonzero(doc[:len(hashes)] == doc[width - 1:width - 1 + len(hashes)])
    hashes, owner = hashes[lead], doc[lead]
    # texts of fewer words are one shingle
    few = np.flatnonzero((per_doc > 0) & (per_doc < width))
    short = [shingle_hashes(words[head[i]:head[i] + per_doc[i]], int(per_doc[i]))[0] for i in few]
    hashes = np.concatenate((hashes, np.array(short, np.uint64)))
    owner = np.concatenate((owner, few))
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    ones = np.zeros((n_docs, 64 * lanes), np.int32)
    for at in range(0, len(hashes), SLICE_SHINGLES):
        part, own = hashes[at:at + SLICE_SHINGLES], owner[at:at + SLICE_SHINGLES]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for k in range(lanes):
            spread = mixed(part + np.uint64((seed + 1 + k) * 0x9E3779B97F4A7C15 % 2 ** 64))
            bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[own[cuts], 64 * k:64 * k + 64] += np.add.reduceat(bits, cuts, axis=0,
                                                                   dtype=np.int32)
    over = 2 * ones > np.bincount(owner, minlength=n_docs)[:, None]
    full = per_doc > 0
    out[full] = np.packbits(over[full], axis=1, bitorder="little").view("<u8")
    return out


def wide_udf(width: int, lanes: int, seed: int):
    @F.arrow_udf("binary")
    def fingerprint(texts: pa.Array) -> pa.Array:
        data, offsets = flat_utf8(texts)
        out, at = [np.zeros((0, lanes), np.uint64)], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            out.append(wide_fingerprints(data[offsets[at]:offsets[to]],
                                         offsets[at:to + 1] - offsets[at], width, lanes, seed))
            at = to
        raw = np.concatenate(out).astype("<u8").tobytes()
        size = 8 * lanes
        return pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())
    return fingerprint


def wide_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of [value, lane] within ``radius`` bits, by tiles of values ordered by
    population count; tiles whose counts differ beyond the radius are skipped. The first two lanes
    alone refuse nearly all pairs."""
    def ordered(x):
        pop = np.bitwise_count(x).sum(1, dtype=np.int64)
        order = np.argsort(pop, kind="stable")
        return order, np.ascontiguousarray(x[order].T), pop[order]
    order_a, sa, pop_a = ordered(a)
    order_b, sb, pop_b = (order_a, sa, pop_a) if same else ordered(b)
    for i in range(0, len(a), WIDE_SMALL):
        low, high = pop_a[i], pop_a[min(i + WIDE_SMALL, len(a)) - 1]
        for j in range(i if same else 0, len(b), WIDE_SMALL):
            if pop_b[j] - high > radius or low - pop_b[min(j + WIDE_SMALL, len(b)) - 1] > radius:
                continue
            x, y = sa[:, i:i + WIDE_SMALL], sb[:, j:j + WIDE_SMALL]
            apart = np.bitwise_count(x[0][:, None] ^ y[0][None, :])
            for lane in range(1, min(2, len(x))):
                apart += np.bitwise_count(x[lane][:, None] ^ y[lane][None, :])
            p, q = np.nonzero(apart <= radius)
            far = apart[p, q].astype(np.int64)
            for lane in range(2, len(x)):
                far += np.bitwise_count(x[lane][p] ^ y[lane][q])
            near = far <= radius
            if near.any():
                yield order_a[i + p[near]], order_b[j + q[near]]


def wide_links(values: DataFrame, radius: int) -> DataFrame:
    """A spanning forest (a, b) of each tile's links among distinct (node, fp)."""
    n = values.count()
    blocks = max(-(-n // WIDE_BLOCK), min(WIDE_BLOCKS, -(-n // WIDE_LEAST)), 1)

    def links(key: tuple, tile: pa.Table) -> pa.Table:
        node, own = tile.column("node").to_numpy(), tile.column("block").to_numpy()
        raw = np.frombuffer(b"".join(tile.column("fp").to_pylist()), "<u8")
        fp = raw.reshape(len(node), -1).astype(np.uint64)
        x, y = key[0].as_py(), key[1].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        root = np.arange(len(node))
        for p, q in wide_pairs(fp[left], fp[right], radius, x == y) if len(left) and len(right) \
                else ():
            root = joined_roots(root, left[p], right[q])
        ends = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[ends], "b": node[root[ends]]})

    own = values.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(blocks)).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("partner")
    tiles = own.select("node", "fp", "block", partner).select(
        "node", "fp", "block", F.least("block", "partner").alias("x"),
        F.greatest("block", "partner").alias("y"))
    # a partition for each tile, as tiles are few and dear
    return (tiles.repartition(blocks * (blocks + 1) // 2, "x", "y").groupBy("x", "y")
            .applyInArrow(links, "a long, b long"))


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5,
                radius: int = 48, lanes: int = 4, seed: int = 42) -> DataFrame:
    """(id, k1, k2, grp), one row for each row of ``docs``: groups of texts whose shingles of
    ``width`` words are similar, by fingerprints of ``lanes`` times 64 bits.

    Two texts with a Jaccard similarity J of their shingles have a cosine near 2J / (1 + J), and
    fingerprints differ in arccos of that over pi of all bits: 39 of 256 at J = 0.8, with a
    deviation of 6, so that a radius of 48 takes 95 in 100 of such pairs and more beyond; unrelated
    texts differ in 128 with a deviation of 8. Texts that are NULL or hold no word form one group.
    Repeated rows fall into one group; NULL ids stay NULL; other columns are not read; an empty
    table gives no rows.
    """
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    k1, k2 = digest128(id_, text)
    slim = written(docs.select(id_.alias("id"), k1.alias("k1"), k2.alias("k2"),
                               wide_udf(width, lanes, seed)(text).alias("fp"))
                   .withColumn("node", F.xxhash64("fp")), "prints")
    values = written(slim.select("node", "fp").dropDuplicates(["node"]), "values")
    linked = written(components(wide_links(values, radius)), "linked")
    return (slim.drop("fp").join(linked, "node", "left")
            .select("id", "k1", "k2", F.coalesce("component", "node").alias("grp")))


def one_near(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options
             ) -> DataFrame:
    """As ``one_of_each``, of the groups of ``near_groups``."""
    return _firsts(docs, near_groups(docs, text_col, id_col, **options), text_col, id_col)


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group.

    That is the row with the smallest id (NULL last); among equal ids the smallest digest of the
    text; of rows equal in both, any one.
    """
    return _firsts(docs, simhash_groups(docs, text_col, id_col, **options), text_col, id_col)


def _firsts(docs: DataFrame, groups: DataFrame, text_col: str, id_col: str) -> DataFrame:
    groups = written(groups, "groups")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    keys = groups.groupBy("grp", "id", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    firsts = written(groups.groupBy("grp").agg(F.min(order).alias("keep")), "firsts")
    marks = (keys.join(firsts, "grp")
             .select("k1", "k2", "n", ((F.col("keep.k1") == F.col("k1"))
                                       & (F.col("keep.k2") == F.col("k2"))).alias("stays"))
             .filter("NOT stays OR n > 1"))
    rows = packed(docs)
    k1, k2 = digest128(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"))
    marked = (rows.select("row", k1.alias("k1"), k2.alias("k2"))
              # marks grow with the table: never broadcast, so that every size runs alike
              .join(written(marks, "marks").hint("merge"), ["k1", "k2"], "left"))
    alone = marked.filter("stays IS NULL").select("row")
    copies = marked.filter("stays").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return alone.union(copies.select("row")).select("row.*")
