"""Queries over file listings: parts, rules, folder views."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import text as T
from shelfmark.functions import vocab as V
from shelfmark.operators import overview as O
from shelfmark.operators import rules as R
from shelfmark.sources.readers import distinct_paths
from workloads import derive as D

DOC_PARTS = D.with_parts_sql(D.DOCS)
PAGE_PARTS = D.with_parts_sql(D.PAGES)
ALL_PARTS = D.with_parts_sql(D.LISTING)
FOLDER2 = "coalesce(nullif(array_to_string(list_slice(dirs, 1, {d}), '\\'), ''), '.')"
JUNK = f"""CASE WHEN lower(base) IN {D.sql_list(V.SAFE_NAMES)} OR starts_with(base, '~$') OR ext IN {D.sql_list(V.SAFE_EXT)} THEN 'safe'
 WHEN ext IN {D.sql_list(V.REVIEW_EXT)} THEN 'review' END"""
# Depth of the unit a folder belongs to, by its own markers only: scanned left to right, smallest positive root wins.
ROOT = """coalesce(list_min(list_filter(list_concat(
 list_transform(list_filter(range(1, len(dirs) + 1), lambda i: lower(dirs[i]) IN ('.git', 'node_modules')), lambda i: i - 1),
 list_transform(list_filter(range(1, len(dirs) + 1), lambda i: lower(dirs[i]) = 'site-packages'), lambda i:
   coalesce(list_transform(list_slice(list_reverse_sort(list_filter(range(1, i), lambda j: lower(dirs[j]) IN ('lib', 'lib64'))), 1, 1),
     lambda j: CASE WHEN j > 1 AND lower(dirs[j - 1]) IN ('venv', '.venv', 'env', '.env', 'virtualenv') THEN j - 2 ELSE j - 1 END)[1], i - 1))),
 lambda r: r > 0)), 0)"""
SPLIT = f"""{{parts}}, roots AS (SELECT DISTINCT array_to_string(list_slice(dirs, 1, r), '/') AS root, r FROM
  (SELECT dirs, {ROOT} AS r FROM parts) WHERE r > 0),
matched AS (SELECT path, arg_min(root, r) AS unit FROM parts JOIN roots ON array_to_string(list_slice(dirs, 1, r), '/') = root
  AND len(dirs) >= r GROUP BY path),
split AS (SELECT parts.*, unit, CASE WHEN unit IS NULL THEN {JUNK} END AS junk,
  CASE WHEN unit IS NOT NULL THEN 'unit' WHEN ({JUNK}) IS NOT NULL THEN 'junk' ELSE 'routed' END AS placement
  FROM parts LEFT JOIN matched USING (path))"""
DOC_SPLIT = SPLIT.format(parts=DOC_PARTS)
TYPE = "CASE WHEN ext = '' THEN '(none)' ELSE ext END"
# Adaptive folder groups, top-down over four fixed depths.
KEYS = ", ".join(f"{FOLDER2.format(d=d)} AS k{d}" for d in (2, 3, 4, 5))
GROUPS = f"""{DOC_SPLIT}, keyed AS (SELECT path, base, {TYPE} AS type, {KEYS} FROM split WHERE placement = 'routed'),
big AS (SELECT greatest(300, count(*) // 30) AS big FROM keyed),
l4 AS (SELECT k4, CASE WHEN count(*) > (SELECT big FROM big) AND count(DISTINCT k5) > 1 THEN count(DISTINCT k5) ELSE 1 END AS n4
  FROM keyed GROUP BY k4),
l3 AS (SELECT k3, CASE WHEN sum(c) > (SELECT big FROM big) AND sum(n4) > 1 THEN sum(n4) ELSE 1 END AS n3 FROM
  (SELECT k3, k4, count(*) AS c, any_value(n4) AS n4 FROM keyed JOIN l4 USING (k4) GROUP BY k3, k4) GROUP BY k3),
l2 AS (SELECT k2, CASE WHEN sum(c) > (SELECT big FROM big) AND sum(n3) > 1 THEN sum(n3) ELSE 1 END AS n2 FROM
  (SELECT k2, k3, count(*) AS c, any_value(n3) AS n3 FROM keyed JOIN l3 USING (k3) GROUP BY k2, k3) GROUP BY k2),
grouped AS (SELECT keyed.*, CASE WHEN n2 = 1 THEN k2 WHEN n3 = 1 THEN k3 WHEN n4 = 1 THEN k4 ELSE k5 END AS folder
  FROM keyed JOIN l2 USING (k2) JOIN l3 USING (k3) JOIN l4 USING (k4)),
sized AS (SELECT folder, count(*) AS files FROM grouped GROUP BY folder)"""


def _split(spark, sf):
    return R.split_inventory(P.with_parts(D.documents(spark, sf)))


def inventory_parts(spark, sf):
    return D.listing(spark, sf).select("path", "dir", "base", "stem", "ext", P.folder_key(F.col("dirs")).alias("folder"))


def junk_tier(spark, sf):
    return P.with_parts(D.documents(spark, sf)).select("path", P.junk_tier(F.col("base")).alias("tier"))


def managed_filter(spark, sf):
    parts = P.with_parts(D.documents(spark, sf))
    hidden = F.exists("dirs", lambda d: d.startswith(".") | P.is_managed(d)) | F.col("base").startswith(".")
    return parts.filter(~hidden).select("path", P.relative_parent(F.col("dirs")).alias("parent"))


def bundle_units(spark, sf):
    return _split(spark, sf).filter("placement = 'unit'").groupBy("unit").agg(F.count(F.lit(1)).alias("files"))


def split_placement(spark, sf):
    return _split(spark, sf).select("path", "placement", "unit", "junk")


def split_overview(spark, sf):
    split = _split(spark, sf)
    return O.overview(split, O.folder_groups(split.filter("placement = 'routed'")))


def has_information(spark, sf):
    return D.listing(spark, sf).select("path", P.has_information(F.col("dirs"), F.col("stem")).alias("informed"))


def plan_text(spark, sf):
    args = (F.col("dirs"), F.col("stem"), F.col("ext"))
    return D.listing(spark, sf).select(
        "path", P.plan_text(*args).alias("text"), P.plan_text(*args, types="kind").alias("kind_text"),
        T.normalise(P.plan_text(*args, types=None)).alias("plain_text"))


def strip_root(spark, sf):
    rooted = D.pages(spark, sf).withColumn("path", F.concat(F.lit("mnt/share/"), F.col("path")))
    return R.strip_scan_root(rooted).select("page_id", "path")


def topic_folders(spark, sf):
    return D.plain_names(spark, sf).select("doc_id", P.sanitise_topic(F.col("name")).alias("topic"))


def type_table(spark, sf):
    return O.type_table(O.folder_groups(_split(spark, sf).filter("placement = 'routed'")))


def folder_groups(spark, sf):
    groups = O.folder_groups(_split(spark, sf).filter("placement = 'routed'"))
    return groups.groupBy("folder").agg(F.sum("files").alias("files"))


def folder_map(spark, sf):
    return O.folder_map(O.folder_groups(_split(spark, sf).filter("placement = 'routed'")))


def folder_samples(spark, sf):
    return O.folder_samples(_split(spark, sf).filter("placement = 'routed'"))


def unique_paths(spark, sf):
    return distinct_paths(D.pages(spark, sf).select("path"))


def _near(prefix="lang"):
    return F.array(F.struct(F.col(prefix).alias("category"), (F.length("source") / 10).alias("score")))


def leftover_groups(spark, sf):
    left = P.with_parts(D.documents(spark, sf)).withColumn("candidates", _near())
    return O.leftover_groups(left).select("folder", "files", "top_types", "sample_names", "closest_buckets")


def spread_sample(spark, sf):
    keyed = D.listing(spark, sf).withColumn("folder", P.folder_key(F.col("dirs"), 1))
    return O.spread_sample(keyed.select("folder", "path"), "folder", "path", 5)


def closest_summary(spark, sf):
    left = P.with_parts(D.documents(spark, sf)).withColumn("candidates", _near()).withColumn("folder", P.folder_key(F.col("dirs"), 1))
    return O.closest_summary(left, "folder")


QUERIES = {f.__name__: f for f in (
    inventory_parts, junk_tier, managed_filter, bundle_units, split_placement, split_overview, has_information, plan_text, strip_root,
    topic_folders, type_table, folder_groups, folder_map, folder_samples, unique_paths, leftover_groups, spread_sample, closest_summary)}

_TEXT = "translate(concat(stem, ' ', coalesce(array_to_string(dirs, ' '), '')), '_-', '  ')"
_WORD = "regexp_replace(ext, '^\\.+', '')"
_KIND = "CASE " + " ".join(f"WHEN {_WORD} IN {D.sql_list(e.split())} THEN ' {k}'" for k, e in V.FILE_KINDS.items()) + " ELSE '' END"
_TOP = "string_agg(concat({item}, '=', CAST({n} AS VARCHAR)), ';' ORDER BY rk)"

ORACLES = {
    "inventory_parts": f"WITH {ALL_PARTS} SELECT path, dir, base, stem, ext, {FOLDER2.format(d=2)} AS folder FROM parts",
    "junk_tier": f"WITH {DOC_PARTS} SELECT path, {JUNK} AS tier FROM parts",
    "managed_filter": f"""WITH {DOC_PARTS} SELECT path, CASE WHEN dir = '' THEN '.' ELSE dir END AS parent FROM parts
 WHERE NOT starts_with(base, '.') AND len(list_filter(dirs, lambda d: starts_with(d, '.') OR d IN {D.sql_list(V.MANAGED_DIRS)}
   OR regexp_matches(d, '^[0-9]{{2}}\\.[0-9]{{2}}_'))) = 0""",
    "bundle_units": f"WITH {DOC_SPLIT} SELECT unit, count(*) AS files FROM split WHERE unit IS NOT NULL GROUP BY unit",
    "split_placement": f"WITH {DOC_SPLIT} SELECT path, placement, unit, junk FROM split",
    "split_overview": f"""WITH {GROUPS}, listed AS (SELECT * FROM sized ORDER BY files DESC, folder LIMIT 250),
 base0 AS (SELECT count(*) AS files_total, count(DISTINCT unit) AS units, count(*) FILTER (placement = 'unit') AS unit_files,
  count(*) FILTER (placement = 'junk') AS junk_files, count(*) FILTER (placement = 'routed') AS needing FROM split)
 SELECT *, (SELECT count(*) FROM sized) AS folders, needing // 150 AS unsorted_allowed, (SELECT count(*) FROM listed) AS folders_listed,
  needing - (SELECT CAST(sum(files) AS BIGINT) FROM listed) AS files_not_listed, CAST(ceil(sqrt(files_total)) AS BIGINT) AS target_min,
  CAST(floor(ceil(sqrt(files_total)) * 1.5) AS BIGINT) AS target_max FROM base0""",
    "has_information": f"""WITH {ALL_PARTS} SELECT path, len(list_filter(regexp_extract_all(lower(concat(dir, '/', stem)), '[a-z]{{3,}}'),
  lambda w: w NOT IN {D.sql_list(V.GENERIC_WORDS)})) > 0 AS informed FROM parts""",
    "plan_text": f"""WITH {ALL_PARTS} SELECT path, CASE WHEN {_WORD} = '' THEN {_TEXT} ELSE concat({_TEXT}, ' ', {_WORD}) END AS text,
  CASE WHEN {_WORD} = '' THEN {_TEXT} ELSE concat({_TEXT}, ' ', {_WORD}, {_KIND}) END AS kind_text,
  trim(regexp_replace({_TEXT}, '[\\s_-]+', ' ', 'g')) AS plain_text FROM parts""",
    "strip_root": f"""WITH {PAGE_PARTS} SELECT page_id, array_to_string(p, '/') AS path FROM parts""",
    "topic_folders": f"""WITH plain AS ({D.PLAIN}),
 clean AS (SELECT doc_id, trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_') AS c FROM plain)
 SELECT doc_id, array_to_string(list_transform(regexp_extract_all(c, '[A-Za-z]+|[^A-Za-z]+'),
  lambda r: concat(upper(r[1:1]), lower(r[2:]))), '') AS topic FROM clean""",
    "type_table": f"""WITH {GROUPS}, t AS (SELECT type, folder, count(*) AS n FROM grouped GROUP BY type, folder),
 top40 AS (SELECT type, CAST(sum(n) AS BIGINT) AS files FROM t GROUP BY type ORDER BY files DESC, type LIMIT 40),
 r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, folder) AS rk FROM t)
 SELECT top40.type, files, {_TOP.format(item='folder', n='n')} AS main_folders FROM top40 JOIN r ON r.type = top40.type AND rk <= 2
 GROUP BY top40.type, files""",
    "folder_groups": f"WITH {GROUPS} SELECT folder, files FROM sized",
    "folder_map": f"""WITH {GROUPS}, listed AS (SELECT * FROM sized ORDER BY files DESC, folder LIMIT 250),
 t AS (SELECT folder, type, count(*) AS n FROM grouped GROUP BY folder, type),
 r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, type) AS rk FROM t)
 SELECT listed.folder, files, {_TOP.format(item='type', n='n')} AS top_types FROM listed JOIN r ON r.folder = listed.folder AND rk <= 3
 GROUP BY listed.folder, files""",
    "folder_samples": f"""WITH {GROUPS}, listed AS (SELECT * FROM sized ORDER BY files DESC, folder LIMIT 250),
 pos AS (SELECT folder, list(grouped.base ORDER BY grouped.path) AS names, count(*) AS n FROM grouped JOIN listed USING (folder) GROUP BY folder)
 SELECT folder, array_to_string(list_transform(CASE WHEN n <= 5 THEN range(1, n + 1) ELSE list_transform(range(0, 5), lambda i: i * n // 5 + 1) END,
  lambda i: names[i]), ';') AS sample_names FROM pos""",
    "unique_paths": f"SELECT DISTINCT path FROM ({D.PAGES})",
    "leftover_groups": f"""WITH {DOC_PARTS}, keyed AS (SELECT path, base, lang, {TYPE} AS type, {FOLDER2.format(d=2)} AS folder FROM parts),
 listed AS (SELECT folder, count(*) AS files FROM keyed GROUP BY folder ORDER BY files DESC, folder LIMIT 150),
 t AS (SELECT folder, type, count(*) AS n FROM keyed GROUP BY folder, type),
 tt AS (SELECT folder, {_TOP.format(item='type', n='n')} AS top_types FROM
  (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, type) AS rk FROM t) WHERE rk <= 3 GROUP BY folder),
 pos AS (SELECT folder, list(base ORDER BY path) AS names, list(lang ORDER BY path) AS langs, count(*) AS n FROM keyed GROUP BY folder),
 pick AS (SELECT folder, names, langs, CASE WHEN n <= 5 THEN range(1, n + 1) ELSE list_transform(range(0, 5), lambda i: i * n // 5 + 1) END AS sel FROM pos),
 sampled AS (SELECT folder, array_to_string(list_transform(sel, lambda i: names[i]), ';') AS sample_names,
  list_transform(sel, lambda i: langs[i]) AS near FROM pick),
 c AS (SELECT folder, category, count(*) AS samples FROM (SELECT folder, unnest(near) AS category FROM sampled) GROUP BY folder, category),
 cc AS (SELECT folder, {_TOP.format(item='category', n='samples')} AS closest_buckets FROM
  (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY samples DESC, category) AS rk FROM c) WHERE rk <= 2 GROUP BY folder)
 SELECT folder, files, top_types, sample_names, closest_buckets FROM listed JOIN tt USING (folder) JOIN sampled USING (folder) JOIN cc USING (folder)""",
    "spread_sample": f"""WITH {ALL_PARTS}, pos AS (SELECT {FOLDER2.format(d=1)} AS folder, path,
  row_number() OVER (PARTITION BY {FOLDER2.format(d=1)} ORDER BY path) - 1 AS place, count(*) OVER (PARTITION BY {FOLDER2.format(d=1)}) AS n FROM parts),
 slots AS (SELECT unnest(range(0, 5)) AS i)
 SELECT folder, path, place AS slot FROM pos WHERE n <= 5
 UNION ALL SELECT folder, path, i AS slot FROM pos JOIN slots ON i * n // 5 = place WHERE n > 5""",
    "closest_summary": f"""WITH {DOC_PARTS}, c AS (SELECT {FOLDER2.format(d=1)} AS folder, lang AS category, count(*) AS samples,
  round(avg(length(source) / 10.0::DOUBLE), 3) AS avg_score FROM parts GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY samples DESC, category) AS rank FROM c)
 SELECT folder, category, samples, avg_score, rank FROM r WHERE rank <= 2""",
}
