"""Reading embedding, scan and feature tables, with the reference data model's checks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("grid", T.StringType()), T.StructField("layer", T.IntegerType()),
    T.StructField("subject", T.StringType()), T.StructField("w", T.LongType()),
    T.StructField("vec", T.ArrayType(T.FloatType()))])

# Seconds per window, number of windows and captions per window of each grid.
GRIDS = [("clip4s", 4, 2700, 1), ("femba", 5, 2160, 2), ("luna", 5, 2160, 2),
         ("steegformer", 6, 1800, 2), ("neurolm", 8, 1350, 2), ("reve", 10, 1080, 3)]


def read_embeddings(spark: SparkSession, path: str, **filters: list[str]) -> DataFrame:
    """One long table; keyword filters (model=[...], grid=[...]) prune partitions.

    A file without a layer is a single layer 0.
    """
    df = spark.read.parquet(path)
    for column, wanted in filters.items():
        df = df.filter(F.col(column).isin(list(wanted)))
    missing = [f for f in EMBEDDING_SCHEMA if f.name not in df.columns]
    df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    return (df.withColumn("layer", F.coalesce(F.col("layer").cast("int"), F.lit(0)))
            .select(*EMBEDDING_SCHEMA.fieldNames()))


def optional_read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the same shape where it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def with_fallback(emb: DataFrame, keys: list[str], preferred: str, fallback: str) -> DataFrame:
    """Rows of the preferred grid per key, else of the fallback, with the grid used shown.

    The two grids have different numbers of windows, so users must look at ``used_grid``.
    """
    both = emb.filter(F.col("grid").isin(preferred, fallback))
    has = both.groupBy(*keys).agg(F.max((F.col("grid") == preferred).cast("int")).alias("__p"))
    want = F.when(F.col("__p") == 1, F.lit(preferred)).otherwise(F.lit(fallback))
    return (both.join(has.select(*keys, want.alias("used_grid")), keys)
            .filter(F.col("grid") == F.col("used_grid")))


def available(registry: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """Registered members that are really there."""
    return registry.join(listing.select(*keys).distinct(), keys, "left_semi")


def checked_width(emb: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """The rows, failing at run time where a key mixes vectors of different length."""
    width = emb.groupBy(*keys).agg(F.min(F.size(vec)).alias("__lo"), F.max(F.size(vec)).alias("__hi"))
    fault = F.when(F.col("__lo") != F.col("__hi"), F.raise_error(F.lit("vectors differ in length"))
                   .cast("int")).otherwise(F.col("__lo"))
    return (emb.join(width.select(*keys, fault.alias("__w")), keys)
            .filter(F.col("__w").isNotNull()).drop("__w"))


def grid_dim(spark: SparkSession) -> DataFrame:
    from isochord.session import inline
    return inline(spark, GRIDS, ["grid", "win_sec", "n_windows", "caps_per_window"])


def window_starts(grids: DataFrame) -> DataFrame:
    """(grid, w, start_s) of every window of every grid."""
    w = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n_windows") - 1).cast("bigint")))
    return (grids.select("grid", "win_sec", w.alias("w"))
            .select("grid", "w", (F.col("w") * F.col("win_sec")).cast("double").alias("start_s")))


def with_retry(read: Callable, attempts: int = 4, base_wait: float = 5.0, sleep=time.sleep):
    """Retries driver-side access with doubling waits; the last failure is raised.

    Reads inside jobs need none of this: Spark repeats failed tasks itself.
    """
    for n in range(1, attempts + 1):
        try:
            return read()
        except Exception:
            if n == attempts:
                raise
            sleep(base_wait * 2 ** (n - 1))
