"""The query of WARC archives, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isochord.llm.rows import table
from isochord.llm.warc import archive_round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_round_trip(table(spark, sf_dir, "pages"), spark, min_bytes=0)
    return back.selectExpr("id AS page_id", "payload_bytes", "payload_digest", "record_type",
                           "refers_to")


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS s,
         min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string([array_to_string([
         substr('{_DIGITS}', 1 + ((('0x' || substr(s, 1 + 5 * i, 5))::INT >> 15) & 31), 1),
         substr('{_DIGITS}', 1 + ((('0x' || substr(s, 1 + 5 * i, 5))::INT >> 10) & 31), 1),
         substr('{_DIGITS}', 1 + ((('0x' || substr(s, 1 + 5 * i, 5))::INT >> 5) & 31), 1),
         substr('{_DIGITS}', 1 + (('0x' || substr(s, 1 + 5 * i, 5))::INT & 31), 1)], '')
         FOR i IN range(8)], '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
