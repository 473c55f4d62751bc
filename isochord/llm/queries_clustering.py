"""The query of centroid clustering and its SQL, one step of which is written for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.clustering import pivot_clusters
from isochord.llm.rows import table

ROUNDS = 5


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pivot_clusters(table(spark, sf_dir, "embeddings"), dim=64, k=40, rounds=ROUNDS,
                         scale=256, seed=2)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
                      "inertia", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")),
                                        256).alias("centroid_sha256"))


def _sql() -> str:
    steps = []
    for i in range(ROUNDS + 1):
        # the nearest centroid, ties to the smaller number
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(v.v, k.v),
           lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': k.c}}) AS m
  FROM v, c{i} AS k GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} AS o LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS v FROM (
      SELECT c, i, floor(sum(x) / count(*))::BIGINT AS x FROM (
        SELECT a.m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i
        FROM v JOIN a{i} AS a USING (r)) GROUP BY c, i) GROUP BY c) AS n ON o.c = n.c)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v)::INT - 1 AS c, v FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= 40),
{", ".join(steps)}
SELECT vec_id, a.m.c AS cluster, a.m.d AS distance,
       sum(a.m.d) OVER (PARTITION BY a.m.c)::BIGINT AS cluster_inertia,
       sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} AS a USING (r) JOIN c{ROUNDS} AS k ON k.c = a.m.c
"""


OP13_SQL = _sql()
