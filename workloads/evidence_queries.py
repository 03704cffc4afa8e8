"""Queries over tokens, phrases and their weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.functions import vocab as V
from shelfmark.operators import evidence as E
from shelfmark.operators import overview as O
from shelfmark.operators import rules as R
from shelfmark.functions import paths as P
from shelfmark.plans import handoff
from shelfmark.sources import sinks
from workloads import derive as D
from workloads.path_queries import ALL_PARTS

NOISE = T.NoiseTerms()
_tok = "regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}')".format
PACKAGED = D.sql_list(NOISE.packaging + NOISE.format)
CLUSTER = f"""coalesce(nullif(array_to_string(list_slice(list_filter(list_transform(dirs, lambda d:
  array_to_string(list_slice(list_filter({_tok(x='d')}, lambda t: t NOT IN {D.sql_list(NOISE.path_scaffolding)}), 1, 2), '_')),
  lambda m: m <> ''), 1, 3), ' > '), ''), 'root')"""
FILES = f"""{ALL_PARTS}, toks AS (SELECT row_number() OVER () AS fid, path, base, ext, {_tok(x='stem')} AS fn,
  CASE WHEN len(dirs) > 0 THEN {_tok(x='dirs[len(dirs)]')} ELSE [] END AS pa,
  {_tok(x="coalesce(array_to_string(list_slice(dirs, 1, len(dirs) - 1), '/'), '')")} AS hi, {CLUSTER} AS cluster FROM parts),
files AS (SELECT *, list_sort(list_distinct(list_concat({_tok(x='ext')}, list_filter(list_concat(list_concat(fn, pa), hi),
  lambda t: t IN {PACKAGED})))) AS fp FROM toks)"""
OCC = f"""{FILES}, occ AS (SELECT fid, path, base, cluster, 'filename' AS src, unnest(fn) AS term FROM files
 UNION ALL SELECT fid, path, base, cluster, 'parent', unnest(pa) FROM files
 UNION ALL SELECT fid, path, base, cluster, 'higher_path', unnest(hi) FROM files
 UNION ALL SELECT fid, path, base, cluster, 'format_package', unnest(fp) FROM files)"""


def _grams(tokens: str) -> str:
    return (
        f"list_transform(list_filter(list_concat(list_transform(range(1, len({tokens})), lambda i: list_slice({tokens}, i, i + 1)), "
        f"list_transform(range(1, len({tokens}) - 1), lambda i: list_slice({tokens}, i, i + 2))), "
        "lambda g: len(list_distinct(g)) > 1), lambda g: array_to_string(g, ' '))"
    )


PHRASES = f"""{FILES}, around AS (SELECT *, list_concat(pa, hi) AS ar FROM files),
pocc AS (SELECT fid, path, base, cluster, 'phrase_filename' AS src, unnest({_grams('fn')}) AS term FROM around
 UNION ALL SELECT fid, path, base, cluster, 'phrase_path', unnest({_grams('ar')}) FROM around)"""
BUNDLES = f"""refs AS (SELECT DISTINCT fid, cluster, src, term FROM occ),
bundles AS (SELECT cluster, count(*) AS refs, count(*) FILTER (term IN {D.sql_list(V.BUNDLE_MARKERS)}) AS packaging_refs FROM refs GROUP BY cluster),
flagged AS (SELECT *, refs >= 40 AND packaging_refs / refs >= 0.18 AS is_bundle FROM bundles)"""


def _weights(occ: str, weights: dict[str, float], kind: str) -> str:
    sums = ", ".join(f"count(*) FILTER (src = '{s}') AS n_{s}" for s in weights)
    raw = " + ".join(f"n_{s} * {w}::DOUBLE" for s, w in weights.items())
    noise = " * ".join(
        f"(CASE WHEN term IN {D.sql_list(words)} THEN {V.NOISE_FACTORS[label]}::DOUBLE ELSE 1 END)" for label, words in NOISE.labels().items())
    labels = ", ".join(f"CASE WHEN term IN {D.sql_list(words)} THEN '{label}' END" for label, words in sorted(NOISE.labels().items()))
    extra = """CASE WHEN share >= 0.6 AND n_higher_path / mentions >= 0.6 AND n_filename / mentions < 0.2 THEN 0.28
      WHEN share >= 0.6 AND n_higher_path / mentions >= 0.4 THEN 0.45 ELSE 1 END"""
    single = kind == "single"
    return f"""tot AS (SELECT count(*) AS nf, count(DISTINCT cluster) AS nc FROM files),
pres AS (SELECT term, count(DISTINCT fid) AS file_presence, count(DISTINCT cluster) AS cluster_presence FROM {occ} GROUP BY term),
inb AS (SELECT term, count(*) AS nb FROM (SELECT DISTINCT term, cluster FROM {occ}) JOIN flagged USING (cluster) WHERE is_bundle GROUP BY term),
counts AS (SELECT term, {sums}, count(*) AS mentions FROM {occ} GROUP BY term),
st AS (SELECT *, ({raw}) AS raw, coalesce(nb, 0) / cluster_presence AS share, 1 - cluster_presence / (nc + 1) AS conc,
  ln((nf + 1) / (file_presence + 1)) + 1 AS idf FROM counts JOIN pres USING (term) LEFT JOIN inb USING (term) CROSS JOIN tot),
w AS (SELECT *, (CASE WHEN share > 0 THEN 0.25::DOUBLE ELSE 1 END) * ({extra if single else '1'}) AS pen, {noise if single else '1'} AS nz,
  coalesce(array_to_string([{labels if single else ''}], ','), '') AS labels FROM st)
SELECT term, '{kind}' AS token_type, round(raw, 4) AS raw_count, file_presence, cluster_presence, round(conc, 4) AS concentration_score,
 labels AS noise_labels, round(pen, 4) AS bundle_penalty, round(raw * idf * (0.6 + conc) * nz * pen, 4) AS adjusted_weight"""


def _evidence(spark, sf):
    return E.file_evidence(D.listing(spark, sf))


def _flat(df):
    return df.drop("source_mix").withColumn("noise_labels", F.array_join("noise_labels", ","))


def tokens(spark, sf):
    return D.pages(spark, sf).select("page_id", F.array_join(T.tokenise(F.col("path")), " ").alias("tokens"))


def file_evidence(spark, sf):
    join = lambda c: F.array_join(c, " ").alias(c)
    return _evidence(spark, sf).select(
        "path", join("filename_tokens"), join("parent_tokens"), join("higher_path_tokens"), join("format_package_tokens"),
        join("candidate_tokens"), "cluster_root")


def path_phrases(spark, sf):
    ev = _evidence(spark, sf).withColumn("around", F.concat("parent_tokens", "higher_path_tokens"))
    return ev.select("path", F.array_join(T.phrases(F.col("filename_tokens")), ";").alias("name_phrases"),
                     F.array_join(T.phrases(F.col("around")), ";").alias("path_phrases"))


def raw_terms(spark, sf):
    return E.raw_term_counts(_evidence(spark, sf))


def bundle_clusters(spark, sf):
    terms = E.cluster_terms(E.exploded_tokens(_evidence(spark, sf)), E.SOURCES)
    return E.bundle_clusters(terms).withColumn("packaging_ratio", F.round("packaging_ratio", 6))


def term_evidence(spark, sf):
    return _flat(E.theme_evidence(_evidence(spark, sf))[0])


def phrase_evidence(spark, sf):
    return _flat(E.theme_evidence(_evidence(spark, sf))[1])


def term_samples(spark, sf):
    ev = _evidence(spark, sf)
    exploded = E.exploded_tokens(ev, ["path", "base"])
    sampled = E.with_samples(E.raw_term_counts(ev), exploded)
    return sampled.select("term", "files", F.array_join("sample_paths", " || ").alias("sample_paths"),
                          F.array_join("sample_files", " || ").alias("sample_files"))


def theme_lines(spark, sf):
    counts, weights = sinks.theme_lists(E.theme_evidence(_evidence(spark, sf))[0])
    return counts.select(F.lit("count").alias("kind"), "line").unionByName(weights.select(F.lit("weight").alias("kind"), "line"))


def theme_union(spark, sf):
    singles, phrases, _ = E.theme_evidence(_evidence(spark, sf))
    return sinks.theme_table(singles, phrases).groupBy("token_type").agg(F.count(F.lit(1)).alias("terms"), F.sum("file_presence").alias("presence"))


def first_handoff(spark, sf):
    parts = P.with_parts(D.documents(spark, sf))
    return handoff.round_one(R.split_inventory(parts), E.file_evidence(parts))


QUERIES = {f.__name__: f for f in (tokens, file_evidence, path_phrases, raw_terms, bundle_clusters, term_evidence, phrase_evidence, term_samples,
                                   theme_lines, theme_union, first_handoff)}

_single = f"{OCC}, {BUNDLES}, {_weights('occ', V.SOURCE_WEIGHTS, 'single')}"
_phrase = f"{PHRASES}, {OCC[len(FILES) + 2:]}, {BUNDLES}, {_weights('pocc', V.PHRASE_WEIGHTS, 'phrase')}"
_cand = "list_sort(list_distinct(list_concat(list_concat(list_concat(fn, pa), hi), fp)))"
_join = "coalesce(array_to_string({x}, ' '), '') AS {n}".format
ORACLES = {
    "tokens": f"SELECT page_id, coalesce(array_to_string({_tok(x='path')}, ' '), '') AS tokens FROM ({D.PAGES})",
    "file_evidence": f"""WITH {FILES} SELECT path, {_join(x='fn', n='filename_tokens')}, {_join(x='pa', n='parent_tokens')},
 {_join(x='hi', n='higher_path_tokens')}, {_join(x='fp', n='format_package_tokens')}, {_join(x=_cand, n='candidate_tokens')},
 cluster AS cluster_root FROM files""",
    "path_phrases": f"""WITH {FILES}, around AS (SELECT *, list_concat(pa, hi) AS ar FROM files)
 SELECT path, coalesce(array_to_string({_grams('fn')}, ';'), '') AS name_phrases, coalesce(array_to_string({_grams('ar')}, ';'), '') AS path_phrases FROM around""",
    "raw_terms": f"WITH {OCC} SELECT term, count(DISTINCT fid) AS files FROM occ GROUP BY term",
    "bundle_clusters": f"""WITH {OCC}, {BUNDLES} SELECT cluster AS cluster_root, refs, packaging_refs, round(packaging_refs / refs, 6) AS packaging_ratio,
 is_bundle FROM flagged""",
    "term_evidence": f"WITH {_single} FROM w",
    "phrase_evidence": f"WITH {_phrase} FROM w",
    "term_samples": f"""WITH {OCC}, d AS (SELECT DISTINCT fid, term, path, base FROM occ),
 r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY path) AS rk FROM d), n AS (SELECT term, count(*) AS files FROM d GROUP BY term)
 SELECT term, any_value(files) AS files, string_agg(path, ' || ' ORDER BY rk) AS sample_paths, string_agg(base, ' || ' ORDER BY rk) AS sample_files
 FROM r JOIN n USING (term) WHERE rk <= 3 GROUP BY term""",
    "theme_lines": f"""WITH e AS (WITH {_single} FROM w) SELECT 'count' AS kind, concat(term, ': ', CAST(floor(raw_count) AS BIGINT)) AS line FROM e
 UNION ALL SELECT 'weight', concat(term, chr(9), format('{{:.4f}}', adjusted_weight)) FROM e""",
    "theme_union": f"""WITH a AS (WITH {_single} FROM w), b AS (WITH {_phrase} FROM w)
 SELECT token_type, count(*) AS terms, CAST(sum(file_presence) AS BIGINT) AS presence FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY token_type""",
}
