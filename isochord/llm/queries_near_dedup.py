"""Queries of near-dedup. That of embeddings has SQL; seeded XXH64 fingerprints have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.embedding_dedup import embedding_groups
from isochord.llm.rows import table
from isochord.llm.simhash import simhash_groups


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), width=4, radius=4, seed=42)
    return groups.select(F.col("id").alias("doc_id"),
                         F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                         "component_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return groups.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                         (F.col("id") == F.col("component_id")).alias("kept"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label
    AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  SELECT vec_id, vec_id AS c FROM embeddings
  UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id,
       e.vec_id = component_id AS kept
FROM embeddings e JOIN m ON e.vec_id = m.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
