"""op12: the 20 best partners of every twentieth embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.segmentsearch import top_scores


def op12_top_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_scores(vectors.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 20
"""
QUERIES = {"op12_top_scores": op12_top_scores}
ORACLES = {"op12_top_scores": ORACLE}
