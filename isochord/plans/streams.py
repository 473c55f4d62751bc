"""Queries that run as streams over the given tables until all input is used."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochord.functions.vectors import r6
from isochord.plans import bindings as B
from isochord.plans import sqltext as S
from isochord.plans.registry import query
from isochord.streaming import windows


def table_stream(spark, sf, name):
    """A given table as a stream; the pattern matches it as one file and as a folder."""
    schema = B.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def events_of(events):
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                         "event_type", "value")


@query("stream_tumbling",
       "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, "
       f"count(*)::BIGINT AS n, {S.r6('sum(value)')} AS total, {S.r6('min(value)')} AS low, "
       f"{S.r6('max(value)')} AS high FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    """Hourly statistics per channel, of every hour."""
    done = windows.tumbling_table(
        events_of(table_stream(spark, sf, "events")), events_of(B.table(spark, sf, "events")),
        ["event_type"], "ts", "value", "1 hour", "10 minutes", "stream-tumbling")
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
                       "event_type", "n", *[r6(c).alias(c) for c in ("total", "low", "high")])


SEG_MS, SEG_N = 8000, 64


def windows_sql(window_ms: int) -> str:
    """Full windows of the recording that the segments make, by sample numbers."""
    per = window_ms * SEG_N // SEG_MS
    return (f"WITH {S.E}, s AS (SELECT w * {SEG_N} + pos AS t, x FROM (SELECT w, "
            f"unnest(range({SEG_N})) AS pos, unnest(v[1:{SEG_N}]) AS x FROM e)), "
            f"g AS (SELECT t // {per} AS w, count(*)::BIGINT AS n, sum(x) AS total, "
            f"arg_min(x, t) AS first FROM s GROUP BY 1) "
            f"SELECT w, n, {S.r6('total')} AS total, {S.r6('first')} AS first FROM g "
            f"WHERE n = {per}")


def segment_query(spark, sf, window_ms, label):
    segments = (table_stream(spark, sf, "embeddings")
                .select(F.lit("base").alias("grid"), F.col("vec_id").cast("bigint").alias("seg"),
                        F.col("embedding").cast("array<double>").alias("samples")))
    out = windows.segment_windows(segments, ["grid"], SEG_MS, SEG_N, window_ms)
    done = windows.run_to_table(out, spark, label)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return done.select("w", F.size("samples").cast("bigint").alias("n"), r6(total).alias("total"),
                       r6(F.col("samples")[0]).alias("first"))


@query("stream_segment_windows", windows_sql(20000))
def stream_segment_windows(spark, sf):
    """20 s windows from 8 s segments (2.5 segments each), carried over segment borders."""
    return segment_query(spark, sf, 20000, "stream-segments")


@query("stream_aligned_windows", windows_sql(80000))
def stream_aligned_windows(spark, sf):
    """80 s windows from 8 s segments, ten segments each."""
    return segment_query(spark, sf, 80000, "stream-aligned")
