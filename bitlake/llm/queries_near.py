"""Queries and SQL of operators 2 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitlake.llm import near_text, near_vectors


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op2_near_vectors": """
WITH RECURSIVE v AS (SELECT row_number() OVER () k, vec_id, label, embedding::DOUBLE[] e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) low FROM r GROUP BY x), n AS (SELECT x, count(*) n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT n_links, least(vec_id, coalesce(low, vec_id))::BIGINT component_id, vec_id = least(vec_id, coalesce(low, vec_id)) kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id""",
}
QUERIES = {"op2_near_vectors": op2_near_vectors, "op10_near_text": op10_near_text}
