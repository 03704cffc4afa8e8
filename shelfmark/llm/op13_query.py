"""op13: the best collocations of each language."""

from __future__ import annotations

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.phrases import LEAST, LONGEST, SHARE, TOP, collocations


def op13_collocations(spark, sf_dir):
    arrow_rows(spark)
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, {LONGEST} + 1) AS s(size) WHERE len(w) >= size)
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL
), kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < {SHARE} * a),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS first, array_to_string(list_slice(w, k + 1, size), ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN t ON t.lang = cut.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY rank <= {TOP}
"""
QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": ORACLE}
