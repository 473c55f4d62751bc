"""Mutual-kNN overlap of two neighbour graphs over the same windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isochord.functions.vectors import modulo
from isochord.operators.ordered import merged


def shared_edges(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Edges (i, j) present on both sides; key columns of either side are kept."""
    return merged(a.drop("rank", "sim"), b.drop("rank", "sim"), [*on, "i", "j"])


def layer_pairs(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
                on: list[str]) -> DataFrame:
    """Every combination of an a-space with a b-space that share the ``on`` columns."""
    return (a.select(*on, *a_keys).distinct()
            .join(b.select(*on, *b_keys).distinct(), on))


def mknn(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
         on: list[str], n_windows: int, k: int,
         pairs: DataFrame | None = None) -> DataFrame:
    """Directed overlap per pair of spaces: shared edges / (W * k), zero kept.

    ``pairs`` lists the pairs wanted; reading them from a small table spares a second
    pass over the edges.
    """
    pairs = layer_pairs(a, b, a_keys, b_keys, on) if pairs is None else pairs
    hits = (shared_edges(a, b, on).groupBy(*on, *a_keys, *b_keys)
            .agg(F.count(F.lit(1)).alias("hits")))
    return (pairs.select(*on, *a_keys, *b_keys)
            .join(hits, [*on, *a_keys, *b_keys], "left")
            .select(*on, *a_keys, *b_keys,
                    (F.coalesce("hits", F.lit(0)) / F.lit(float(n_windows * k)))
                    .alias("mknn")))


def mknn_per_window(a: DataFrame, b: DataFrame, on: list[str], k: int) -> DataFrame:
    """Share of a window's neighbours that both sides agree on, zero kept."""
    hits = (a.select(*on, "i", "j", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
            .union(b.select(*on, "i", "j", F.lit(0), F.lit(1)))
            .groupBy(*on, "i", "j").agg((F.sum("in_a") * F.sum("in_b")).alias("hit")))
    return (hits.groupBy(*on, "i")
            .agg((F.sum("hit") / F.lit(float(k))).alias("share"))
            .withColumnRenamed("i", "w"))


def best_pair(scores: DataFrame, keys: list[str], layers: list[str],
              score: str = "mknn") -> DataFrame:
    """The highest-scoring layer pair; the first pair wins a tie."""
    first = F.min_by(F.struct(*layers, score),
                     F.struct((-F.col(score)).alias("s"), *layers))
    if not keys:
        return scores.agg(first.alias("b")).select("b.*")
    return scores.groupBy(*keys).agg(first.alias("b")).select(*keys, "b.*")


def relabel(edges: DataFrame, d: int, n_windows: int) -> DataFrame:
    """The graph of the space rotated by ``d`` windows, without a new search."""
    return (edges.withColumn("i", modulo(F.col("i") + d, n_windows))
            .withColumn("j", modulo(F.col("j") + d, n_windows)))


def shared_sets(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Neighbours of each window on which both sides agree: (on, i, j)."""
    return shared_edges(a.select(*on, "i", "j"), b.select(*on, "i", "j"), on)


def ranked_once(df: DataFrame, keys: list[str], order, name: str) -> DataFrame:
    """Position inside the key group, starting at 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


def mknn_by_k(a: DataFrame, b: DataFrame, on: list[str], n_windows: int,
              ks: list[int]) -> DataFrame:
    """Overlap as the neighbourhood widens, from one search at the largest k.

    A shared edge counts for every k that reaches its worse rank; only counts per rank are
    kept, at most one per neighbour place.
    """
    worse = F.greatest(F.col("ra"), F.col("rb"))
    met = (merged(a.select(*on, "i", "j", F.col("rank").alias("ra")),
                  b.select(*on, "i", "j", F.col("rank").alias("rb")), [*on, "i", "j"])
           .groupBy(*on, worse.alias("rank")).agg(F.count(F.lit(1)).alias("hits")))
    reached = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank")))
    per_k = met.select(*on, reached.alias("k"), "hits").groupBy(*on, "k").agg(
        F.sum("hits").alias("hits"))
    return per_k.select(*on, "k", (F.col("hits") / (F.col("k") * float(n_windows))).alias("mknn"))
