"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of ``documents``.
NULL texts, empty tables, repeated rows and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.decontamination import clean
from isochord.llm.line_dedup import drop_repeated_lines
from isochord.llm.mixing import mixed
from isochord.llm.quality import scored
from isochord.llm.rows import table
from isochord.llm.simhash import one_near
from isochord.session import ship, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    out = scored(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return out.filter("predicted = 1").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows. A
    document that has no other lines stays, with an empty text."""
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    new = {"text": F.col("kept_text"),
           "n_chars": F.when(F.col("n_dropped") == 0, F.col("row.n_chars"))
           .otherwise(F.char_length("kept_text"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c)
                        for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more
    (fingerprints of 256 bits, of which 48 may differ)."""
    return one_near(docs, width=5, radius=48, lanes=4, seed=42)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("source_mix", source_mix)]

#: A fitted model and seeded fingerprints have no SQL; tests hold every stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
