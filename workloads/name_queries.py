"""Queries over file names: dates, versions, labels, standard and contextual names, collisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V
from shelfmark.operators.collisions import collision_plan
from shelfmark.operators.context_names import contextual_names
from shelfmark.operators.journal import undo_plan
from shelfmark.operators.standardize import standardize_names
from workloads import derive as D
from workloads.path_queries import DOC_PARTS

# Date-like names from event times: several written forms, some invalid on purpose.
DATED = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN concat('Bill_', d, '-', m, '-', y) WHEN 1 THEN concat('Report ', y, '-', m, '-', d)
 WHEN 2 THEN concat('FY ', y, '-', substring(CAST(CAST(y AS INT) + 1 AS STRING), 3, 2)) WHEN 3 THEN concat('x', d, m, y, ' ', d, m, y)
 WHEN 4 THEN concat('Notes ', mon, ' ', y) WHEN 5 THEN concat(mon, '-Dec ', y) WHEN 6 THEN concat('scan ', m, d, substring(y, 3, 2))
 WHEN 7 THEN concat('v', d, ' Rev_', m, ' (', d, ')') ELSE concat('plan ', y, '_', d) END AS name FROM (SELECT event_id,
 substring(CAST(ts AS STRING), 1, 4) AS y, substring(CAST(ts AS STRING), 6, 2) AS m, substring(CAST(ts AS STRING), 9, 2) AS d,
 CASE event_id % 4 WHEN 0 THEN 'Jan' WHEN 1 THEN 'SEPT' WHEN 2 THEN 'march' ELSE 'October' END AS mon FROM events)"""


def _dated(spark, sf):
    D.table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(DATED)


def _plain(spark, sf):
    names = D.plain_names(spark, sf)
    return names.withColumn("base", F.trim(P.stem_of(F.col("name")))).withColumn("ext", F.lower(P.extension(F.col("name"))))


def name_date(spark, sf):
    return _dated(spark, sf).select("event_id", N.extract_date(F.col("name")).alias("doc_date"))


def name_version(spark, sf):
    return _dated(spark, sf).select("event_id", N.extract_version(F.col("name")).alias("version")).unionByName(
        _plain(spark, sf).select(F.col("doc_id").alias("event_id"), N.extract_version(F.col("base")).alias("version")))


def name_words(spark, sf):
    words = N.split_words(F.col("base"))
    return _plain(spark, sf).select("doc_id", F.array_join(words, " ").alias("words"), F.array_join(N.meaningful(words), " ").alias("useful"),
                                    N.strip_benign(F.col("base")).alias("clean"))


def name_chunks(spark, sf):
    words = _plain(spark, sf).withColumn("w", N.split_words(F.col("base")))
    chunks = words.withColumn("c", N.canonical_chunks(F.col("w")))
    return chunks.select("doc_id", F.array_join("c", " ").alias("chunks"), F.array_join(F.transform("c", N.format_chunk), "_").alias("formatted"))


def name_type(spark, sf):
    text = _plain(spark, sf).withColumn("text", F.array_join(N.split_words(F.col("base")), " "))
    typed = text.withColumn("doc_type", N.infer_type("text", F.col("ext")))
    return typed.select("doc_id", "doc_type", N.first_label("text", V.ISSUERS).alias("issuer"), N.first_label("text", V.STATUSES).alias("status"),
                        N.pattern_class(F.col("doc_type"), F.col("ext")).alias("pattern_class"))


def part_type(spark, sf):
    parts = D.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return parts.select("p_partkey", N.first_label("text", V.DOC_TYPES).alias("doc_type"), N.first_label("text", V.STATUSES).alias("status"))


def vague_names(spark, sf):
    return _plain(spark, sf).select("doc_id", N.is_vague(F.col("base"), F.col("ext")).alias("vague"))


def name_gates(spark, sf):
    base = F.col("base")
    return _plain(spark, sf).select("doc_id", N.is_weak(base).alias("weak"), N.is_standard(base).alias("standard"))


def standard_names(spark, sf):
    return standardize_names(D.plain_names(spark, sf), "name")


def standard_part_names(spark, sf):
    """Names of many kinds made of the part table: papers, lectures, plans, media, numbered and dated ones."""
    return standardize_names(D.part_names(spark, sf), "name")


def context_names(spark, sf):
    return contextual_names(P.with_parts(D.documents(spark, sf))).select("path", "context_name")


def content_names(spark, sf):
    """The whole text of every document takes part."""
    return contextual_names(P.with_parts(D.documents(spark, sf, "text")), content="text").select("path", "context_name")


def collision_names(spark, sf):
    """All documents renamed into one folder per language, over names already there."""
    rows = D.documents(spark, sf).join(D.plain_names(spark, sf).select("doc_id", "name"), "doc_id")
    requests = rows.select("path", F.col("lang").alias("folder"), F.regexp_replace(P.stem_of(F.col("name")), "[0-9]{2,}", "").alias("base"),
                           F.lower(P.extension(F.col("name"))).alias("ext"))
    existing = D.plain_names(spark, sf).select(F.col("lang").alias("folder"), "name").distinct()
    return collision_plan(requests, existing)


def undo(spark, sf):
    """Every document's move undone against the listing that is now present."""
    names = D.plain_names(spark, sf).withColumn("old", F.concat_ws("/", "lang", "source", "name"))
    journal = names.select(F.col("doc_id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), "old", F.concat_ws("/", "lang", "name").alias("new"))
    present = names.filter("doc_id % 2 = 0").select(F.concat_ws("/", "lang", "name").alias("path")).unionByName(
        names.filter("doc_id % 5 = 0").select(F.col("old").alias("path")))
    return undo_plan(journal, present).select("seq", "status")


QUERIES = {f.__name__: f for f in (name_date, name_version, name_words, name_chunks, name_type, part_type, vague_names, name_gates, standard_names, standard_part_names,
                                   context_names, content_names, collision_names, undo)}

# ---- oracles ----------------------------------------------------------------------------------------------------------
PLAIN = f"""nm AS ({D.PLAIN}), nx AS (SELECT *, regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext0 FROM nm),
plain AS (SELECT *, trim(substring(name, 1, length(name) - length(ext0))) AS base, lower(ext0) AS ext FROM nx)"""
WORDS = "regexp_extract_all(replace(replace({x}, '%20', ' '), '&', ' and '), '[A-Za-z0-9]+')"
_months = "|".join(V.MONTHS)


def _g(pattern: str, group: int) -> str:
    return f"regexp_extract(raw, '{pattern}', {group}, 'i')"


def _day(pattern: str, y: int, m: int, d: int, century: str = "") -> str:
    return (f"CASE WHEN {_g(pattern, m)} BETWEEN '01' AND '12' AND {_g(pattern, d)} BETWEEN '01' AND '31' THEN "
            f"concat('{century}', {_g(pattern, y)}, '-', {_g(pattern, m)}, '-', {_g(pattern, d)}) END")


def _month(pattern: str) -> str:
    y, m = _g(pattern, 1), _g(pattern, 2)
    return (f"CASE WHEN {m} BETWEEN '01' AND '12' OR TRY_CAST({m} AS INT) = (TRY_CAST(substring({y}, 3, 2) AS INT) + 1) % 100 "
            f"THEN concat({y}, '-', {m}) END")


_named = f"\\b({_months})[ _.-]*(20\\d{{2}})\\b"
_monthno = "CASE lower(" + _g(_named, 1) + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.MONTHS.items()) + " END"
DATE = "coalesce(" + ", ".join([
    _day("\\b(20\\d{2})[-_](\\d{2})[-_](\\d{2})\\b", 1, 2, 3),
    _day("(?:^|[^0-9])(\\d{2})[-_. ](\\d{2})[-_. ](20\\d{2})(?:[^0-9]|$)", 3, 2, 1),
    _month("\\b(20\\d{2})[-_](\\d{2})\\b"),
    _day("\\b(\\d{2})(\\d{2})(20\\d{2})\\b", 3, 2, 1),
    _day("\\b(\\d{2})(\\d{2})(\\d{2})\\b", 3, 2, 1, "20"),
    f"CASE WHEN {_monthno} IS NOT NULL AND NOT regexp_matches(raw, '\\b({_months})[ _.-]+(?:to[ _.-]+)?({_months})[ _.-]*20\\d{{2}}', 'i') "
    f"THEN concat({_g(_named, 2)}, '-', {_monthno}) END",
    f"nullif({_g('\\b(20\\d{2})\\b', 1)}, '')",
    _month("\\b(\\d{4})[-_](\\d{2})\\b"),
]) + ")"
VERSION = "coalesce(" + ", ".join(
    [f"CASE WHEN {_g(p, 1)} <> '' THEN concat('{label}', {_g(p, 1)}) END" for label, p in V.VERSIONS] + [f"nullif({_g('\\((\\d+)\\)$', 1)}, '')"]) + ")"


def _label(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{'|'.join(p)}', 'i') THEN '{label}'" for label, p in rules) + " END"


TYPE = f"""coalesce({_label('text', V.DOC_TYPES)}, CASE WHEN ext IN {D.sql_list(V.IMAGE_EXT)} THEN
 CASE WHEN regexp_matches(text, '\\b(site|inspection|photo|portrait|selfie)\\b', 'i') THEN 'Photo' ELSE 'MediaFile' END
 WHEN ext IN {D.sql_list(V.DATA_EXT)} THEN 'Data' WHEN ext IN {D.sql_list(V.DOC_EXT)} THEN 'Document' END)"""
CLASS = "CASE " + " ".join(
    f"WHEN coalesce(doc_type IN {D.sql_list(types or [''])}, false) OR ext IN {D.sql_list(exts or ['?'])} THEN '{name}'"
    for name, (types, exts, _, _) in V.PATTERN_CLASSES.items()) + " END"
_noise = "|".join(V.NOISE_TOKENS)
_useful = f"list_filter(w, lambda x: lower(x) NOT IN {D.sql_list(V.NAME_STOPWORDS)} AND NOT regexp_matches(x, '{_noise}', 'i'))"
_jn = "coalesce(array_to_string({x}, '{sep}'), '')".format
CLEAN = "regexp_replace(regexp_replace(base, '^[ _.\\-]+', ''), '(?:\\bcopy|\\bscanned|\\bscan|\\bfinal|\\(\\d+\\)|[\\s_.\\-])+$', '', 'i')"
_counted = "(regexp_matches({x}, '^[A-Za-z]{{1,4}}$') OR lower({x}) IN " + D.sql_list(V.COUNTED_WORDS) + ")"
_digits = "regexp_matches({x}, '^\\d+$')"
_cap = "concat(upper({x}[1:1]), {x}[2:])"
_low_cap = "concat(upper({x}[1:1]), lower({x}[2:]))"
# Words joined to their numbers, then two-word phrases joined; both look at neighbours only.
CHUNKS = f"""m AS (SELECT doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda i:
  CASE WHEN i > 1 AND {_digits.format(x='w[i]')} AND {_counted.format(x='w[i - 1]')} THEN NULL
   WHEN i < len(w) AND {_counted.format(x='w[i]')} AND {_digits.format(x='w[i + 1]')}
    THEN concat(CASE WHEN length(w[i]) <= 4 THEN upper(w[i]) ELSE {_low_cap.format(x='w[i]')} END, w[i + 1])
   WHEN i < len(w) AND regexp_matches(w[i], '^[qQ]\\d$') THEN upper(w[i]) WHEN i < len(w) AND lower(w[i]) = 'vs' THEN 'vs' ELSE w[i] END),
  lambda x: x IS NOT NULL) AS c FROM ws),
ch AS (SELECT doc_id, list_filter(list_transform(range(1, len(c) + 1), lambda i:
  CASE WHEN i > 1 AND lower(concat(c[i - 1], ' ', c[i])) IN {D.sql_list(V.PHRASE_PAIRS)} THEN NULL
   WHEN i < len(c) AND lower(concat(c[i], ' ', c[i + 1])) IN {D.sql_list(V.PHRASE_PAIRS)} THEN concat(c[i], '_', c[i + 1]) ELSE c[i] END),
  lambda x: x IS NOT NULL) AS c FROM m)"""
_upper = "(regexp_matches({x}, '[A-Z]') AND NOT regexp_matches({x}, '[a-z]'))"
_mixed = "(regexp_matches({x}, '[A-Z]') AND regexp_matches({x}, '[a-z]'))"
_pascal = f"CASE WHEN {_mixed.format(x='y')} OR ({_upper.format(x='y')} AND length(y) <= 6) OR {_digits.format(x='y')} THEN y ELSE {_low_cap.format(x='y')} END"
FORMAT = f"""CASE WHEN contains(x, '_') THEN array_to_string(list_transform(string_split(x, '_'), lambda y: {_pascal}), '')
 WHEN x = 'vs' OR ({_upper.format(x='x')} AND length(x) <= 8) OR {_digits.format(x='x')} THEN x ELSE {_cap.format(x='x')} END"""
_vw = "regexp_extract_all(lower(base), '[a-z0-9]+')"
_fill = f"len(list_filter({_vw}, lambda x: x IN {D.sql_list(V.VAGUE_MARKERS)}))"
VAGUE = f"""CASE WHEN base = '' THEN true WHEN ext IN {D.sql_list(V.IMAGE_EXT)} AND regexp_matches(base, '^\\d{{1,6}}(?:_[a-z0-9]*)*$', 'i') THEN false
 WHEN regexp_matches(lower(base), '{'|'.join(V.VAGUE_NAMES)}') THEN true
 WHEN len({_vw}) <= 1 THEN lower(base) IN {D.sql_list(V.VAGUE_MARKERS)} ELSE {_fill} >= greatest(1, len({_vw}) // 2) END"""
_standard = "(?:\\d{4}(?:-\\d{2}){0,2}|[A-Z][A-Za-z0-9]+)"
_ctx = "regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _context(content: str | None) -> str:
    """Ranked terms per file from long tables; the name is put together like the operator documents it."""
    text = f"UNION ALL SELECT path, unnest({_ctx.format(x='text')}) AS t, unnest(range(0, len({_ctx.format(x='text')}))) AS pos, 3 AS w FROM src" if content else ""
    stop = D.sql_list(V.CONTEXT_STOPWORDS)
    return f"""around AS (SELECT *, concat_ws(' ', stem, CASE WHEN len(dirs) > 0 THEN dirs[len(dirs)] END, CASE WHEN len(dirs) > 1 THEN dirs[len(dirs) - 1] END) AS cx FROM src),
tk AS (SELECT path, unnest({_ctx.format(x='cx')}) AS t, unnest(range(0, len({_ctx.format(x='cx')}))) + 1000000 AS pos, 2 AS w FROM around
 UNION ALL SELECT path, unnest({_ctx.format(x='ext')}) AS t, unnest(range(0, len({_ctx.format(x='ext')}))) + 2000000 AS pos, 1 AS w FROM src {text}),
tw AS (SELECT path, t, sum(w) AS w, min(pos) AS pos FROM tk WHERE length(t) >= 3 AND t NOT IN {stop} GROUP BY path, t),
tr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY w DESC, pos, t) AS r FROM tw),
tt AS (SELECT path, list(concat(upper(t[1:1]), t[2:]) ORDER BY r) AS words FROM tr WHERE r <= 5 GROUP BY path),
cn AS (SELECT src.path, words, regexp_extract(trim(stem), '^(\\d{{1,6}}(?:_[a-z0-9]*)*)$', 1, 'i') AS serial FROM src JOIN tt USING (path))
SELECT path, trim(substring(CASE WHEN serial <> '' THEN concat(serial, '_', array_to_string(list_slice(words, 1, 4), '_'))
 ELSE array_to_string(words, '_') END, 1, 170), '_') AS context_name FROM cn"""


ORACLES = {
    "name_date": f"WITH d AS (SELECT event_id, replace(name, '%20', ' ') AS raw FROM ({DATED})) SELECT event_id, {DATE} AS doc_date FROM d",
    "name_version": f"""WITH {PLAIN}, d AS (SELECT event_id, name AS raw FROM ({DATED}) UNION ALL SELECT doc_id, base FROM plain)
 SELECT event_id, {VERSION} AS version FROM d""",
    "name_words": f"""WITH {PLAIN}, ws AS (SELECT doc_id, base, {WORDS.format(x='base')} AS w FROM plain)
 SELECT doc_id, {_jn(x='w', sep=' ')} AS words, {_jn(x=_useful, sep=' ')} AS useful, {CLEAN} AS clean FROM ws""",
    "name_chunks": f"""WITH {PLAIN}, ws AS (SELECT doc_id, {WORDS.format(x='base')} AS w FROM plain), {CHUNKS}
 SELECT doc_id, {_jn(x='c', sep=' ')} AS chunks, {_jn(x=f'list_transform(c, lambda x: {FORMAT})', sep='_')} AS formatted FROM ch""",
    "name_type": f"""WITH {PLAIN}, t AS (SELECT doc_id, ext, array_to_string({WORDS.format(x='base')}, ' ') AS text FROM plain),
 u AS (SELECT *, {TYPE} AS doc_type FROM t)
 SELECT doc_id, doc_type, {_label('text', V.ISSUERS)} AS issuer, {_label('text', V.STATUSES)} AS status, {CLASS} AS pattern_class FROM u""",
    "part_type": f"""WITH t AS (SELECT p_partkey, concat(p_name, ' ', p_type) AS text FROM part)
 SELECT p_partkey, {_label('text', V.DOC_TYPES)} AS doc_type, {_label('text', V.STATUSES)} AS status FROM t""",
    "vague_names": f"WITH {PLAIN} SELECT doc_id, {VAGUE} AS vague FROM plain",
    "name_gates": f"""WITH {PLAIN} SELECT doc_id, regexp_matches(lower(base), '{'|'.join(V.WEAK_NAMES)}') AS weak,
 regexp_matches(base, '^_*{_standard}(?:_+{_standard})+_*$') AS standard FROM plain""",
    "context_names": f"WITH {DOC_PARTS}, src AS (SELECT * FROM parts), {_context(None)}",
    "content_names": f"""WITH {D.with_parts_sql(D.DOCS.replace('source FROM documents', 'source, text FROM documents'))},
 src AS (SELECT * FROM parts), {_context('text')}""",
    "collision_names": f"""WITH {PLAIN}, ex AS (SELECT DISTINCT lang AS folder, lower(name) AS f FROM nm),
 docs AS ({D.DOCS}),
 rq AS (SELECT docs.path, lang AS folder, regexp_replace(substring(name, 1, length(name) - length(ext0)), '[0-9]{{2,}}', '', 'g') AS base, ext
  FROM plain JOIN docs USING (doc_id, lang)),
 full0 AS (SELECT *, concat(base, ext) AS n0 FROM rq),
 fx AS (SELECT *, regexp_extract(n0, '^\\.*[^.].*(\\.[^.]*)$', 1) AS x FROM full0),
 f AS (SELECT *, substring(n0, 1, length(n0) - length(x)) AS s FROM fx),
 taken AS (SELECT folder, f FROM ex UNION SELECT folder, lower(n0) FROM f),
 q AS (SELECT f.*, ex.f IS NOT NULL AS on_disk, row_number() OVER (PARTITION BY f.folder, lower(n0) ORDER BY path) AS r
  FROM f LEFT JOIN ex ON ex.folder = f.folder AND ex.f = lower(n0)),
 e AS (SELECT *, CASE WHEN on_disk THEN r ELSE r - 1 END AS nth FROM q),
 grp AS (SELECT folder, lower(s) AS ls, lower(x) AS lx, max(nth) AS need FROM e GROUP BY ALL HAVING max(nth) > 0),
 slot AS (SELECT folder, ls, lx, unnest(range(1, need + 1 + (SELECT count(*) FROM taken t WHERE t.folder = grp.folder AND starts_with(t.f, concat(ls, '_'))))) AS k FROM grp),
 free AS (SELECT slot.*, row_number() OVER (PARTITION BY slot.folder, ls, lx ORDER BY k) AS nth FROM slot
  LEFT JOIN taken ON taken.folder = slot.folder AND taken.f = concat(ls, '_', CAST(k AS VARCHAR), lx) WHERE taken.f IS NULL)
 SELECT path, e.folder, base, ext, CASE WHEN e.nth = 0 THEN n0 ELSE concat(s, '_', CAST(k AS VARCHAR), x) END AS final_name
 FROM e LEFT JOIN free ON free.folder = e.folder AND ls = lower(s) AND lx = lower(x) AND free.nth = e.nth""",
    "undo": f"""WITH nm AS ({D.PLAIN}), j AS (SELECT doc_id, concat(lang, '/', source, '/', name) AS old, concat(lang, '/', name) AS new FROM nm),
 present AS (SELECT new AS path FROM j WHERE doc_id % 2 = 0 UNION SELECT old FROM j WHERE doc_id % 5 = 0)
 SELECT doc_id AS seq, CASE WHEN new NOT IN (SELECT path FROM present) THEN 'skipped_missing'
  WHEN old IN (SELECT path FROM present) THEN 'skipped_occupied' ELSE 'would_restore' END AS status FROM j""",
}
