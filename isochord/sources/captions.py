"""Caption files: a JSON array of {video, text}, ordered by the number in the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.operators.text import clip_id


def read_captions(spark: SparkSession, path: str, n_clips: int | None = None) -> DataFrame:
    """(clip, text): all captions, or the first ``n_clips``, numbered from 0 in clip-id order."""
    raw = (spark.read.schema("video string, text string").option("multiLine", "true").json(path)
           .select(clip_id(F.col("video")).alias("id"), "text"))
    # numbers follow from the sizes of the sorted ranges, so no task holds all captions
    numbered = (raw.orderBy("id", "text").rdd.zipWithIndex().map(lambda r: (r[1], r[0]["text"]))
                .toDF("clip bigint, text string"))
    return numbered if n_clips is None else numbered.filter(F.col("clip") < n_clips)
