"""Writing results cell by cell, and finding the cells still to do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def write_cells(df: DataFrame, path: str, cell: list[str]) -> None:
    """Replaces exactly the cells present in ``df`` and leaves all others alone."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*cell).parquet(path))


def pending(requested: DataFrame, path: str, cell: list[str]) -> DataFrame:
    """Requested cells that are not written yet; only partition names are read."""
    try:
        done = requested.sparkSession.read.parquet(path).select(*cell).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return requested
    typed = done.select(*[done[c].cast(requested.schema[c].dataType).alias(c) for c in cell])
    return requested.join(typed, cell, "left_anti")
