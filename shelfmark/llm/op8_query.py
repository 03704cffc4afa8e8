"""op8: benchmark windows in every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.decontaminate import contamination


def op8_decontamination(spark, sf_dir):
    arrow_rows(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS content
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT uid, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS content
  FROM (SELECT uid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (SELECT DISTINCT uid, k, n, item_id FROM dw JOIN iw USING (n, content)),
p AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(generate_series(k, k + n - 1)) AS x FROM h) GROUP BY uid),
t AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item_id::VARCHAR AS item FROM h) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (uid) LEFT JOIN t USING (uid)
"""
QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES = {"op8_decontamination": ORACLE}
