"""Near-duplicate embeddings by randomised binary codes with exact recomputation.

Each unit vector o is rotated by one random rotation and coded by its signs; with the code is
stored f, the inner product of the rotated vector and its code x (signs over the root of the
dimension). For another rotated unit vector q let s be the inner product of x and q. Then s / f
is an unbiased estimate of the cosine, and there are two upper bounds for it: one that holds
with the confidence of ``sigmas`` (the part of o beside x is a random direction), and one that
always holds, f s + sqrt((1 - f^2) (1 - s^2)). Pairs whose lower of the two bounds stays below
the threshold are done; all others are computed from the vectors themselves in double
precision, and these alone become links.

Vectors meet within a label only. A label is cut into blocks of ``block`` vectors by hash, and a
task compares a pair of blocks, so a label with a third of all vectors makes more tasks, not a
larger one. A task returns one count for each vector and a spanning forest of its links, so
groups of near copies never become pairs. The search looks at every pair of a label: its work
grows with the square of the largest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochord.llm.components import components, joined_roots
from isochord.session import written

BLOCK = 8192
SMALL = 1024
#: Of the confidence bound; beyond eight, one link in 10**13 would be missed by it.
SIGMAS = 8.0
#: Slack for single-precision bounds.
SLACK = 1e-4


@lru_cache(8)
def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random rotation: the orthogonal factor of a normal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def coded(units: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, packed sign bits, correction factors) of unit vectors."""
    turned = units.astype(np.float32) @ rotation(units.shape[1], seed)
    bits = np.packbits(turned >= 0, axis=1)
    return turned, bits, np.abs(turned).sum(axis=1) / np.sqrt(np.float32(units.shape[1]))


def estimates(bits: np.ndarray, factors: np.ndarray, turned: np.ndarray, sigmas: float = SIGMAS
              ) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimate, upper bound) of the cosines of coded with rotated vectors."""
    dim = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    s = (signs / np.sqrt(np.float32(dim))) @ turned.T
    f = np.clip(factors, 1e-6, 1)[:, None]
    estimate = s / f
    beside = np.sqrt(1 - f * f)
    always = f * s + beside * np.sqrt(np.clip(1 - s * s, 0, None))
    # the bound always holds where the rotated vector is nearer to the code than the coded one
    always = np.where(s > f, 1, always)
    likely = estimate + sigmas * beside / f / np.sqrt(max(dim - 1, 1))
    return estimate, np.minimum(always, likely)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool,
                 sigmas: float = SIGMAS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of vectors with cosine of at least ``threshold``; each unordered
    pair of different vectors once if ``same`` (a is b)."""
    ua = a / np.linalg.norm(a, axis=1, keepdims=True)
    ub = ua if same else b / np.linalg.norm(b, axis=1, keepdims=True)
    _, bits, factors = coded(ua)
    turned = coded(ub)[0]
    for i in range(0, len(a), SMALL):
        for j in range(i if same else 0, len(b), SMALL):
            _, upper = estimates(bits[i:i + SMALL], factors[i:i + SMALL], turned[j:j + SMALL],
                                 sigmas)
            open_ = upper >= threshold - SLACK
            if same and i == j:
                open_ = np.triu(open_, 1) | np.triu(open_.T, 1)
            rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(rows):
                continue
            x, y = a[i + rows], b[j + cols]
            exact = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None]
                                 * np.linalg.norm(y, axis=1)[None, :])
            p, q = np.nonzero((exact >= threshold) & open_[np.ix_(rows, cols)])
            if len(p):
                yield i + rows[p], j + cols[q]


def _tile(threshold: float, sigmas: float):
    def links(key: tuple, tile: pa.Table) -> pa.Table:
        x, y = key[-2].as_py(), key[-1].as_py()
        ids, block = tile.column("rid").to_numpy(), tile.column("block").to_numpy()
        flat = tile.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), -1).astype(np.float64)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        root, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(left) and len(right):
            for p, q in linked_pairs(vectors[left], vectors[right], threshold, x == y, sigmas):
                p, q = left[p], right[q]
                count += np.bincount(p, minlength=len(ids)) + np.bincount(q, minlength=len(ids))
                root = joined_roots(root, p, q)
        ends, linked = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(count)
        return pa.table({"a": np.concatenate((ids[ends], ids[linked])),
                         "b": np.concatenate((ids[root[ends]], ids[linked])),
                         "n": np.concatenate((np.zeros(len(ends), np.int64), count[linked]))})
    return links


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     label_col: str = "label", threshold: float = 0.93, block: int = BLOCK,
                     sigmas: float = SIGMAS) -> DataFrame:
    """(id, n_links, component_id), one row for each row of ``vectors``.

    Rows are linked if their labels are equal and their cosine is at least ``threshold``; n_links
    counts the other rows linked directly, component_id is the smallest id reachable, itself
    included (NULL only if all are). Rows with a NULL label, and vectors that are NULL, empty,
    zero or hold NULL or non-finite components link with nothing; nor do vectors of different
    lengths. Rows that repeat are linked with each other; NULL ids stay NULL. Other columns are
    not read. An empty table gives no rows.
    """
    vec, label = F.col(f"`{vec_col}`").cast("array<double>"), F.col(f"`{label_col}`")
    # rows are numbered once and for all by being written
    rows = written(vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"),
        label.alias("label"), F.col(f"`{vec_col}`").alias("vec"),
        (label.isNotNull() & F.coalesce(
            F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0), F.lit(False))).alias("usable")), "vectors")
    usable = rows.filter("usable").select("rid", "label", F.size("vec").alias("dim"), "vec")
    blocks = written(usable.groupBy("label", "dim").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    own = usable.join(blocks, ["label", "dim"]).withColumn(
        "block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    tiles = own.select("rid", "label", "dim", "vec", "block", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner"))
    found = written(tiles.select("rid", "label", "dim", "vec", "block",
                                 F.least("block", "partner").alias("x"),
                                 F.greatest("block", "partner").alias("y"))
                    .groupBy("label", "dim", "x", "y")
                    .applyInArrow(_tile(threshold, sigmas), "a long, b long, n long"), "found")
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    linked = written(components(found.filter("n = 0").select("a", "b")), "linked")
    named = linked.join(rows.select(F.col("rid").alias("node"), "id"), "node")
    least = written(named.groupBy("component").agg(F.min("id").alias("least")), "least")
    groups = (linked.join(least, "component")
              .select("node", F.struct("least").alias("of")))
    return (rows.select("rid", "id").join(counts, F.col("rid") == F.col("a"), "left")
            .join(groups, F.col("rid") == F.col("node"), "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("of.least"))
                    .alias("component_id")))
