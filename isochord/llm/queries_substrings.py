"""The query of repeated byte strings. SQL over all windows takes minutes at the smallest sizes,
so tests compare with a direct count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.rows import table
from isochord.llm.substring_dedup import drop_repeated_strings


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_strings(table(spark, sf_dir, "documents"), length=200)
    return out.select(F.col("id").alias("doc_id"), "n_bytes",
                      F.coalesce(F.aggregate("spans", F.lit(0).cast("long"),
                                             lambda a, x: x - a), F.lit(0)).alias("n_removed"),
                      (F.size("spans") / 2).cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
