"""Queries that write what the given tables say in the formats of the readers and sinks, and work on what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V
from shelfmark.operators import context_names as N
from shelfmark.operators import evaluate as G
from shelfmark.operators import evidence as E
from shelfmark.operators import index as I
from shelfmark.operators import overview as O
from shelfmark.operators import rules as R
from shelfmark.plans import handoff
from shelfmark.session import run_folder
from shelfmark.sources import readers, sinks
from workloads import derive as D
from workloads import evidence_queries, name_queries, path_queries, sort_queries

CASE_EXT = "CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '.txt' END"
BUCKET = "CASE WHEN doc_id % 5 = 0 THEN 'fr' ELSE lang END"


def _folder(spark, label):
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _index_file(spark, sf, languages, code, profiled, word):
    """An index as one JSON document: a category for each source and language, the languages of each source set aside, some profiles."""
    docs = D.table(spark, sf, "documents").filter(F.col("lang").isin(languages))
    groups = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("ord")).withColumn("name", F.concat_ws("_", "source", "lang"))
    told = F.struct(F.concat(F.lit(word), F.col("source")).alias("description"), F.array("lang", "source").alias("aliases"),
                    F.array("name").alias("positive_examples"))
    entries = lambda cond, value: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(
        cond, F.struct("ord", "name", value.alias("value"))))), lambda x: F.struct(x["name"], x["value"])))
    index = groups.agg(entries(F.lit(True), F.lit(code)).alias("categories"), entries(profiled, told).alias("profiles"))
    aside = groups.groupBy("source").agg(F.sort_array(F.collect_list("lang"), asc=word == "base ").alias("paths"))
    aside = aside.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "paths")))).alias("incubation"))
    path = _folder(spark, "index")
    index.crossJoin(aside).select(F.to_json(F.struct("categories", "incubation", "profiles")).alias("value")).coalesce(1).write.text(path)  # one row each
    return path


def merged_index(spark, sf):
    """Two index files read and merged: codes, order and profiles of categories, and the files set aside."""
    base = _index_file(spark, sf, ["de", "en"], "10.01", F.col("lang") == "en", "base ")
    source = _index_file(spark, sf, ["de", "fr"], "20.02", (F.col("lang") == "fr") | F.col("source").endswith("1"), "new ")
    merged = I.merge_indexes(readers.read_index(spark, base), readers.read_index(spark, source))
    aside = I.merge_incubation(readers.read_incubation(spark, base), readers.read_incubation(spark, source))
    none = F.lit(None)
    categories = merged.select(
        F.lit("category").alias("kind"), F.col("category").alias("name"), F.col("cat_ord").cast("long").alias("ord"), "code",
        F.col("profile.description").alias("description"), F.array_join("profile.aliases", ";").alias("aliases"),
        F.array_join("profile.positive_examples", ";").alias("examples"), none.cast("string").alias("paths"))
    return categories.unionByName(aside.select(
        F.lit("incubation").alias("kind"), F.col("topic").alias("name"), F.lit(-1).cast("long").alias("ord"), none.cast("string").alias("code"),
        none.cast("string").alias("description"), none.cast("string").alias("aliases"), none.cast("string").alias("examples"),
        F.array_join("paths", ";").alias("paths")))


def case_texts(spark, sf):
    """Labelled cases written as JSON lines: the text a classifier reads, from the whole document."""
    path = _folder(spark, "cases")
    D.table(spark, sf, "documents").selectExpr(
        f"concat(CAST(doc_id AS STRING), {D.DOC_PLAIN_NAME}) AS current_name", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS parent_path",
        f"{CASE_EXT} AS extension", "text AS text_excerpt", "lang AS expected_category", "source AS expected_coarse_group").write.json(path)
    return readers.read_cases(spark, path).select("current_name", "expected_category", "expected_coarse_group", F.sha1("text").alias("text_sha1"))


def judged_rows(spark, sf):
    """A truth table as CSV and bucket names as JSON, read and joined to assignments."""
    truth, alias = _folder(spark, "truth"), _folder(spark, "aliases")
    docs = D.documents(spark, sf)
    docs.select("path", F.upper("lang").alias("bucket"), F.concat_ws('," ', "source", "lang").alias("tag")).write.csv(truth, header=True, quote='"', escape='"')
    named = docs.select("lang").filter("lang IN ('de', 'en', 'fr')").distinct()
    named = named.agg(F.map_from_entries(F.array_append(F.array_sort(F.collect_list(F.struct("lang", F.upper("lang").alias("name")))), F.struct(
        F.lit("_comment").alias("lang"), F.lit("no data").alias("name")))).alias("m"))
    named.select(F.to_json("m").alias("value")).coalesce(1).write.text(alias)
    assigned = docs.selectExpr("path", f"{BUCKET} AS bucket")
    return G.with_truth(assigned, readers.read_truth(spark, truth), readers.read_aliases(spark, alias)).select("path", "bucket", "expected", "tag", "got")


def theme_rows(spark, sf):
    """The evidence of single terms and phrases, row by row, from the file that holds both."""
    singles, phrases, _ = E.theme_evidence(E.file_evidence(D.listing(spark, sf)))
    path = _folder(spark, "themes")
    sinks.write_theme_evidence(singles, phrases, path)
    return evidence_queries._flat(readers.read_evidence(spark, path))


def plan_rows(spark, sf):
    """The organisation plan, from the files that hold it by destination."""
    plan = sort_queries.organization_plan(spark, sf)
    path = _folder(spark, "plan")
    sinks.write_plan(plan, path)
    return spark.read.schema(plan.schema).parquet(path)


def bundle_roots(spark, sf):
    return handoff.bundle_roots(E.file_evidence(D.listing(spark, sf))).select("cluster_root", "refs", "packaging_refs")


def handoff_rows(spark, sf):
    """The first handoff document, read back: terms, phrases, folders with samples, types."""
    doc = handoff.round_one(R.split_inventory(P.with_parts(D.documents(spark, sf))), E.file_evidence(D.listing(spark, sf)))
    item = "array<struct<term:string,adjusted_weight:double,folder:string,files:double,type:string,sample_names:string>>"
    parsed = doc.select(F.from_json("handoff", f"top_single_terms {item}, top_phrases {item}, folder_map {item}, file_type_table {item}").alias("d"))
    rows = None
    for part, name, number in (("top_single_terms", "term", "adjusted_weight"), ("top_phrases", "term", "adjusted_weight"), ("folder_map", "folder", "files"),
                               ("file_type_table", "type", "files")):
        each = parsed.select(F.posexplode(f"d.{part}").alias("pos", "x")).select(
            F.lit(part).alias("part"), (F.col("pos") + 1).cast("long").alias("rank"), F.col(f"x.{name}").alias("name"),
            F.round(F.col(f"x.{number}"), 3).alias("number"), F.col("x.sample_names").alias("samples"))
        rows = each if rows is None else rows.unionByName(each)
    return rows


def leftover_handoff(spark, sf):
    """The leftover document, read back: groups with the categories they came close to and their mean scores."""
    left = P.with_parts(D.documents(spark, sf)).withColumn("candidates", path_queries._near())
    index = I.index_frame(spark, sort_queries.LANGS)
    verdict = left.agg(F.count(F.lit(1)).alias("unsorted"))
    doc = handoff.leftovers(verdict, index, O.leftover_groups(left))
    kind = ("verdict struct<unsorted:long>, current_index array<struct<category:string,code:string>>, "
            "leftover_groups array<struct<folder:string,files:long,closest:array<struct<category:string,samples:long,avg_score:double>>>>")
    parsed = doc.select(F.from_json("handoff", kind).alias("d")).select(
        F.col("d.verdict.unsorted").alias("unsorted"), F.size("d.current_index").cast("long").alias("categories"), F.explode("d.leftover_groups").alias("g"))
    return parsed.select("unsorted", "categories", "g.folder", "g.files", F.posexplode("g.closest").alias("rank", "c")).select(
        "unsorted", "categories", "folder", "files", F.col("rank").cast("long").alias("rank"), "c.category", "c.samples", "c.avg_score")


def _labelled(suffix):
    def labelled_names(spark, sf):
        files = P.with_parts(D.documents(spark, sf)).withColumn("label", F.expr("CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(source, ' the ', lang, ' shelf') END"))
        return N.contextual_names(files, label="label", serial_as_suffix=suffix).select("path", "context_name")

    return labelled_names


QUERIES = {f.__name__: f for f in (merged_index, case_texts, judged_rows, theme_rows, plan_rows, bundle_roots, handoff_rows, leftover_handoff)}
QUERIES |= {"labelled_names": _labelled(False), "labelled_serials": _labelled(True)}

# ---- oracles ----------------------------------------------------------------------------------------------------------


def _side(languages: str, code: str, profiled: str, word: str) -> str:
    return f"""SELECT *, CASE WHEN {profiled} THEN concat('{word}', source) END AS description, CASE WHEN {profiled} THEN concat(lang, ';', source) END AS aliases,
  CASE WHEN {profiled} THEN name END AS examples FROM (SELECT source, lang, concat(source, '_', lang) AS name, '{code}' AS code,
  row_number() OVER (ORDER BY min(doc_id), concat(source, '_', lang)) - 1 AS pos FROM documents WHERE lang IN {languages} GROUP BY source, lang)"""


_stop = D.sql_list(V.CONTEXT_STOPWORDS)
_cap = "concat(upper(x[1:1]), lower(x[2:]))"


def _labels(suffix: bool) -> str:
    """Names with a label: the label's words, then the serial or the words of the file's own name, then ranked terms."""
    base = name_queries._context(None)
    ranked = base[: base.index("SELECT path, trim(substring(CASE WHEN serial")]
    words = lambda x: f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda x: lower(x) NOT IN {_stop})"
    vague = name_queries.VAGUE.replace("(base)", "(trim(stem))").replace("base =", "trim(stem) =").replace("(base,", "(trim(stem),")
    serial = "list_concat(lw[1:4], [serial])" if suffix else "list_concat(list_concat(lw[1:2], [serial]), own[1:2])"
    return f"""WITH {path_queries.DOC_PARTS}, src AS (SELECT * FROM parts), {ranked},
nl AS (SELECT src.*, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(source, ' the ', lang, ' shelf') END AS label, words, serial FROM src JOIN cn USING (path)),
ow AS (SELECT *, list_transform({words('label')}, lambda x: {_cap}) AS lw, CASE WHEN trim(stem) = '' OR (ext IN {D.sql_list(V.IMAGE_EXT)} AND serial <> '') OR {vague}
  THEN [] ELSE list_transform({words('trim(stem)')}, lambda x: {_cap})[1:3] END AS own FROM nl),
al AS (SELECT *, CASE WHEN label = '' THEN CASE WHEN serial <> '' THEN list_concat([serial], words[1:4]) ELSE words END
  WHEN serial <> '' THEN {serial} WHEN len(own) > 0 THEN list_concat(lw, own) ELSE list_concat(lw, words[1:greatest(0, 5 - len(lw))]) END AS parts FROM ow)
SELECT path, trim(substring(array_to_string(parts[1:5], '_'), 1, 170), '_') AS context_name FROM al"""


_O, _EV = path_queries.ORACLES, evidence_queries.ORACLES


def _top(part: str, sql: str, name: str, number: str, samples: str = "NULL::VARCHAR", limit: int = 120) -> str:
    return f"""SELECT '{part}' AS part, row_number() OVER (ORDER BY {number} DESC, {name}) AS rank, {name} AS name, round({number}::DOUBLE, 3) AS number,
 {samples} AS samples FROM ({sql}) QUALIFY rank <= {limit}"""


ORACLES = {
    "merged_index": f"""WITH b AS ({_side("('de', 'en')", '10.01', "lang = 'en'", 'base ')}),
 s AS ({_side("('de', 'fr')", '20.02', "lang = 'fr' OR source LIKE '%1'", 'new ')}),
 bl AS (SELECT source, list(lang ORDER BY lang) AS l FROM b GROUP BY source), sl AS (SELECT source, list(lang ORDER BY lang DESC) AS l FROM s GROUP BY source)
 SELECT 'category' AS kind, coalesce(b.name, s.name) AS name, coalesce(b.pos, s.pos + (SELECT count(*) FROM b))::BIGINT AS ord, coalesce(s.code, b.code) AS code,
  coalesce(s.description, b.description) AS description, coalesce(s.aliases, b.aliases) AS aliases, coalesce(s.examples, b.examples) AS examples, NULL AS paths
 FROM b FULL JOIN s ON b.name = s.name
 UNION ALL SELECT 'incubation', coalesce(bl.source, sl.source), -1, NULL, NULL, NULL, NULL,
  array_to_string(list_concat(coalesce(bl.l, []), list_filter(coalesce(sl.l, []), lambda x: NOT list_contains(coalesce(bl.l, []), x))), ';')
 FROM bl FULL JOIN sl ON bl.source = sl.source""",
    "case_texts": f"""SELECT concat(CAST(doc_id AS VARCHAR), {D.DOC_PLAIN_NAME}) AS current_name, lang AS expected_category, source AS expected_coarse_group,
 sha1(trim(concat_ws(' ', nullif(concat(CAST(doc_id AS VARCHAR), {D.DOC_PLAIN_NAME}), ''), nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END, ''),
 nullif({CASE_EXT}, ''), nullif(text, '')))) AS text_sha1 FROM documents""",
    "judged_rows": f"""SELECT path, {BUCKET} AS bucket, upper(lang) AS expected, concat(source, '," ', lang) AS tag,
 CASE WHEN {BUCKET} IN ('de', 'en', 'fr') AND {BUCKET} IN (SELECT lang FROM documents) THEN upper({BUCKET}) ELSE {BUCKET} END AS got FROM ({D.DOCS})""",
    "theme_rows": f"WITH a AS ({_EV['term_evidence']}), b AS ({_EV['phrase_evidence']}) FROM a UNION ALL BY NAME FROM b",
    "plan_rows": sort_queries.ORACLES["organization_plan"],
    "bundle_roots": f"SELECT cluster_root, refs, packaging_refs FROM ({_EV['bundle_clusters']}) WHERE is_bundle",
    "handoff_rows": " UNION ALL ".join([
        _top("top_single_terms", _EV["term_evidence"], "term", "adjusted_weight"), _top("top_phrases", _EV["phrase_evidence"], "term", "adjusted_weight"),
        _top("folder_map", f"SELECT * FROM ({_O['folder_map']}) LEFT JOIN ({_O['folder_samples']}) USING (folder)", "folder", "files", "sample_names", 250),
        _top("file_type_table", _O["type_table"], "type", "files", limit=40)]),
    "leftover_handoff": _O["leftover_groups"][: _O["leftover_groups"].index(" c AS (SELECT folder, category, count(*)")].replace(
        "SELECT path, base, lang,", "SELECT path, base, lang, length(source) / 10.0::DOUBLE AS near_score,").replace(
        "list(lang ORDER BY path) AS langs", "list({'category': lang, 'score': near_score} ORDER BY path) AS langs") + """
 c AS (SELECT folder, n.category AS category, count(*) AS samples, round(avg(n.score), 3) AS avg_score FROM (SELECT folder, unnest(near) AS n FROM sampled) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY samples DESC, category) - 1 AS rank FROM c)
 SELECT (SELECT count(*) FROM documents) AS unsorted, 4::BIGINT AS categories, folder, files, rank, category, samples, avg_score FROM listed JOIN r USING (folder) WHERE rank < 2""",
    "labelled_names": _labels(False),
    "labelled_serials": _labels(True),
}
