"""Tumbling windows over streams of events or signal segments.

Windows need not be a multiple of the segment length: a segment is cut at window borders and
each piece goes to its window, whose state waits until all samples are there. A window is emitted
as soon as it is full, in whatever order segments come; an incomplete one never appears.
Statistics of event windows are emitted as the watermark passes; the windows still open when a
stream has ended are added from a batch over their events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from isochord.session import scratch_path


def tumbling_stats(events: DataFrame, keys: list[str], ts: str, value: str, width: str,
                   lateness: str) -> DataFrame:
    """Count, sum and extremes per key and window."""
    return (events.withWatermark(ts, lateness)
            .groupBy(F.window(ts, width).alias("__w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
                 F.min(value).alias("low"), F.max(value).alias("high"))
            .select(F.col("__w.start").alias("start"), *keys, "n", "total", "low", "high"))


def segment_windows(segments: DataFrame, keys: list[str], segment_ms: int, n_samples: int,
                    window_ms: int, last_window: int | None = None) -> DataFrame:
    """(keys, w, samples) from a stream of (keys, seg, samples) in any order.

    Sample k of segment s is sample s * n_samples + k of the recording; window w holds the
    samples of ``window_ms``. Segments past ``last_window`` are not read.
    """
    per_window = window_ms * n_samples // segment_ms
    if last_window is not None:
        segments = segments.filter(F.col("seg") * segment_ms < (last_window + 1) * window_ms)
    first = F.col("seg") * n_samples
    lo = F.greatest(F.col("w") * per_window - first, F.lit(0))
    hi = F.least((F.col("w") + 1) * per_window - first, F.lit(n_samples))
    pieces = (segments.select(*keys, "seg", "samples", F.explode(F.sequence(
        F.floor(first / per_window), F.floor((first + n_samples - 1) / per_window))).alias("w"))
        .select(*keys, "w", (first + lo).alias("t"), F.slice(
            "samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece")))
    if last_window is not None:
        pieces = pieces.filter(F.col("w") <= last_window)
    held = T.StructType([T.StructField("t", T.ArrayType(T.LongType())),
                         T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType())))])
    out = T.StructType([*(segments.schema[k] for k in keys), T.StructField("w", T.LongType()),
                        T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def fill(key, batches, state):
        t, x = ([*v] for v in state.get) if state.exists else ([], [])
        for pdf in batches:
            t += pdf["t"].tolist()
            x += [np.asarray(v, float).tolist() for v in pdf["piece"]]
        if sum(map(len, x)) < per_window:
            state.update((t, x))
            return
        state.remove()
        order = sorted(range(len(t)), key=t.__getitem__)
        samples = [v for i in order for v in x[i]]
        yield pd.DataFrame([[*key, samples]], columns=out.names)

    return pieces.groupBy(*keys, "w").applyInPandasWithState(
        fill, out, held, "append", GroupStateTimeout.NoTimeout)


def tumbling_table(stream: DataFrame, events: DataFrame, keys: list[str], ts: str, value: str,
                   width: str, lateness: str, label: str) -> DataFrame:
    """Every window of a stream that has ended, also those its last watermark left open.

    ``events`` are the stream's events as a batch; only open windows are taken from it.
    """
    spark = stream.sparkSession
    closed, end = run_stream(tumbling_stats(stream, keys, ts, value, width, lateness), spark, label)
    open_ = (events.withColumn("__open", F.window(ts, width)["end"])
             .filter(F.col("__open") > F.lit(end).cast("timestamp")).drop("__open"))
    return closed.unionByName(tumbling_stats(open_, keys, ts, value, width, lateness))


def run_stream(stream: DataFrame, spark: SparkSession, label: str) -> tuple[DataFrame, str]:
    """Processes everything now available; the table it was written to, and the last watermark.

    Output and checkpoint lie in the shared folder, so a restart goes on where it stopped.
    """
    base = scratch_path(spark, label)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    marks = [x["eventTime"]["watermark"] for x in q.recentProgress
             if "watermark" in (x["eventTime"] or {})]
    table = spark.read.schema(stream.schema).parquet(f"{base}/data")
    return table, max(marks, default="1970-01-01T00:00:00.000Z")


def run_to_table(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """The table of a stream that needs no watermark."""
    return run_stream(stream, spark, label)[0]
