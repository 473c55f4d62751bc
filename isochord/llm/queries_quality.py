"""The query of document quality; a fitted model has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isochord.llm.quality import scored
from isochord.llm.rows import table


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("row.doc_id", "held_out", "score", "predicted")
