"""Sources mixed to target weights: each source's words are repeated or thinned to its target.

The words of each source are summed (partial sums meet before the shuffle), targets follow
from the sums by filling up to the caps in closed form, and each document is taken
floor(rate) times plus one copy by a Bernoulli draw whose seed is a hash of the document. No
document waits for another one, so a source with a third of all rows is no special case; only
the table of sources (one row each) is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochord.llm.rows import packed
from isochord.session import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in the order of their code points, NULL last, take the weights in turn. Together they
    are to get ``share`` times all words; a target stops at ``most`` times its source's words and
    the excess is shared by weight among the rest, until none is above. That ends where
    target = min(cap, weight * level), and the level follows from running sums over the sources
    ordered by cap / weight. A source without words has target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighted = by_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighted = weighted.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    level = ((share * F.sum("source_size").over(Window.partitionBy())
              - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0.0)))
             / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = weighted.withColumn("level", level)
    below = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))
                  ).over(Window.partitionBy())
    return (level.withColumn("level", below)
            .select("source", "source_size",
                    F.when(F.col("level").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target")))


def planned(docs: DataFrame, text_col: str = "text", source_col: str = "source",
            id_col: str = "doc_id", weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
            most: float = 2.0, seed: int = 0) -> DataFrame:
    """(row, size, source_size, target, rate, copies) for each row of ``docs``.

    The draw of a document is a hash of the seed, its id and its text: the same in every run,
    after a lost task, and on any number of machines; rows equal in both share it. A NULL text
    has size 0 and NULL is a source of its own. ``row`` holds all columns of ``docs``.
    """
    sizes = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"),
                        word_count(F.col(f"`{text_col}`")).alias("size"))
    # one row a source: written, so that its size is known and the rows with texts stay in place
    targets = written(source_targets(sizes, weights, share, most), "targets").withColumnRenamed(
        "source", "of")
    rows = packed(docs).select(
        "row", F.col(f"row.`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"row.`{text_col}`")).alias("size"),
        draw(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"), seed).alias("u"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = F.col("rate") - F.floor("rate")
    return (rows.join(targets, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("rate", rate)
            .select("row", "size", "source_size", "target", "rate",
                    (F.floor("rate") + F.when(F.col("u") < fraction, 1).otherwise(0))
                    .cast("long").alias("copies")))


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of seed, id and text."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")),
                       F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as many times as ``planned`` says, with its own columns only."""
    plan = planned(docs, **options).filter(F.col("copies") > 0)
    many = plan.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return many.select("row.*")
