"""Queries of line dedup and mixing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.line_dedup import drop_repeated_lines
from isochord.llm.mixing import planned
from isochord.llm.rows import table


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("row.doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM m GROUP BY r
"""


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return plan.select("row.doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|'
                             || md5(coalesce(text, ''))), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE
              AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT max(level) FROM v WHERE cap > weight * level), cap))
           AS target FROM v),
r AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
