"""Folders of numbered .npy files (scans, signal segments) as tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _flat(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.load(io.BytesIO(b), allow_pickle=False).ravel()
                       .astype(np.float64))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _rows(content: pd.Series) -> pd.Series:
    return content.map(lambda b: list(np.load(io.BytesIO(b), allow_pickle=False)
                                      .astype(np.float64)))


def numbered_files(spark: SparkSession, folder: str, max_id: int | None = None) -> DataFrame:
    """(id, path, content) of every <number>.npy below the folder.

    Only name and length are read until ``content`` is used; ``max_id`` ends the range.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.npy").load(folder)
             .withColumn("id", F.regexp_extract("path", r"/(\d+)\.npy$", 1))
             .filter(F.col("id") != "").withColumn("id", F.col("id").cast("bigint")))
    files = files if max_id is None else files.filter(F.col("id") < max_id)
    return files.select("id", "path", "content")


def read_scans(spark: SparkSession, folder: str, n_scans: int) -> DataFrame:
    """(tr, vec) of one subject's scans."""
    return numbered_files(spark, folder, n_scans).select(
        F.col("id").alias("tr"), _flat("content").alias("vec"))


def read_segments(spark: SparkSession, folder: str, n_segments: int, n_channels: int,
                  n_samples: int) -> DataFrame:
    """(seg, ch, samples) of one recording, cropped to the wanted channels and samples."""
    return (numbered_files(spark, folder, n_segments)
            .select(F.col("id").alias("seg"),
                    F.posexplode(F.slice(_rows("content"), 1, n_channels)).alias("ch", "s"))
            .select("seg", "ch", F.slice("s", 1, n_samples).alias("samples")))


def complete_segments(segments: DataFrame, keys: list[str], n_segments: int) -> DataFrame:
    """Every segment 0..n-1 per key; an absent one has NULL samples."""
    want = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_segments - 1).cast("bigint")))
    return (segments.select(*keys).distinct().select(*keys, want.alias("seg"))
            .join(segments, [*keys, "seg"], "left"))
