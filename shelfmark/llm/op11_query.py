"""op11: product codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, table
from shelfmark.llm.vectorcodes import ENTRIES, PARTS, ROUNDS, encode, train


def op11_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialise(encode(vectors, books, keep=["vec_id", "label"]), "codes")
    # Exact beyond 64 bits; the totals are written so that their size is known: a small table goes to the tasks, a large one is
    # joined by label, where a label that holds a third of all rows is split.
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(total.try_cast("long").alias("label_error")), "label-errors")
    joined = coded.join(sums, coded.label.eqNullSafe(sums["of"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    nearest = """SELECT vec_id, label, p, v, m % {e} AS j, m // {e} AS d FROM (
      SELECT x.vec_id, x.label, x.p, x.v, min({e} * list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) + b.j)::BIGINT AS m
      FROM x JOIN b{k} b USING (p) GROUP BY ALL)"""
    parts = f"""WITH kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), x AS MATERIALIZED (
      SELECT vec_id, label, p::INT AS p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) AS t(p)
    ), b0 AS MATERIALIZED (
      SELECT p, j, v FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM x) WHERE j < {ENTRIES}
    )"""
    for k in range(ROUNDS):
        parts += f""", a{k} AS MATERIALIZED ({nearest.format(e=ENTRIES, k=k)}),
    m{k} AS MATERIALIZED (
      SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
        SELECT p, j, i, sum(c)::BIGINT AS s, count(*)::BIGINT AS n FROM (
          SELECT p, j, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL
    ), b{k + 1} AS MATERIALIZED (SELECT o.p, o.j, coalesce(m.v, o.v) AS v FROM b{k} o LEFT JOIN m{k} m ON o.p = m.p AND o.j = m.j)"""
    return parts + f""", f AS MATERIALIZED ({nearest.format(e=ENTRIES, k=ROUNDS)}),
    c AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id, label)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
      (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _oracle()}
