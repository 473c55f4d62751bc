"""The query of secret scans; a trained network has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.rows import table
from isochord.llm.secrets import secrets


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_assign", "n_access", "n_hex",
                      F.sha2("base", 256).alias("base_sha256"), "spans")
