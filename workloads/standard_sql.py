"""Name standardisation written a second time, as stages of SQL: the oracle of ``standard_names`` and ``standard_part_names``.

Every function gives the SQL of one rule for DuckDB; the stages below put them together.  Words, types, dates and versions come from
the oracles of the single rules in ``name_queries``.
"""

from __future__ import annotations

from shelfmark.functions import vocab as V
from workloads import derive as D
from workloads import name_queries as Q

_EDGES = "regexp_replace({x}, '^_+|_+$', '', 'g')"
_COMPACT = "lower(regexp_replace({x}, '[\\W_]+', '', 'g'))"
_CODE = "regexp_matches({x}, '^[A-Za-z]{{1,5}}\\d{{1,6}}[A-Za-z0-9]*$')"


def _in(x: str, words) -> str:
    return f"coalesce({x} IN {D.sql_list(words or ['?'])}, false)"


def _any(x: str, patterns) -> str:
    return f"regexp_matches({x}, '{'|'.join(patterns)}', 'i')"


def _some(items: str, name: str, condition: str) -> str:
    return f"len(list_filter({items}, lambda {name}: {condition})) > 0"


def _every(items: str, name: str, condition: str) -> str:
    return f"len(list_filter({items}, lambda {name}: NOT ({condition}))) = 0"


def _counted(w: str) -> str:
    """Words with their numbers joined."""
    here, before, after = f"{w}[i]", f"{w}[i - 1]", f"{w}[i + 1]"
    counts = lambda x: Q._counted.format(x=x)
    digits = lambda x: Q._digits.format(x=x)
    return f"""list_filter(list_transform(range(1, len({w}) + 1), lambda i: CASE WHEN i > 1 AND {digits(here)} AND {counts(before)} THEN NULL
 WHEN i < len({w}) AND {counts(here)} AND {digits(after)} THEN concat(CASE WHEN length({here}) <= 4 THEN upper({here})
  ELSE {Q._low_cap.format(x=here)} END, {after})
 WHEN i < len({w}) AND regexp_matches({here}, '^[qQ]\\d$') THEN upper({here}) WHEN i < len({w}) AND lower({here}) = 'vs' THEN 'vs' ELSE {here} END),
 lambda x: x IS NOT NULL)"""


def _paired(c: str) -> str:
    """Two-word phrases joined."""
    pairs = D.sql_list(V.PHRASE_PAIRS)
    return f"""list_filter(list_transform(range(1, len({c}) + 1), lambda i: CASE WHEN i > 1 AND lower(concat({c}[i - 1], ' ', {c}[i])) IN {pairs} THEN NULL
 WHEN i < len({c}) AND lower(concat({c}[i], ' ', {c}[i + 1])) IN {pairs} THEN concat({c}[i], '_', {c}[i + 1]) ELSE {c}[i] END), lambda x: x IS NOT NULL)"""


def _form(chunks: str, kind: str) -> str:
    titled = _some(chunks, "c", "regexp_matches(lower(replace(c, '_', ' ')), '\\b(report|notes|book|policy|analysis|design)\\b')")
    coded = _some(chunks, "c", _CODE.format(x="replace(c, '_', '')"))
    return f"""CASE WHEN {_in('ext', V.MEDIA_EXT)} THEN 'title' WHEN {kind} IS NOT NULL THEN 'record'
 WHEN {_in('ext', V.TECHNICAL_EXT)} OR {coded} THEN 'artifact' WHEN {titled} THEN 'title' ELSE 'weak' END"""


def _type(text: str) -> str:
    return Q.TYPE.replace("regexp_matches(text,", f"regexp_matches({text},")


def _useful(words: str) -> str:
    return f"list_filter({words}, lambda x: lower(x) NOT IN {D.sql_list(V.NAME_STOPWORDS)} AND NOT {_any('x', V.NOISE_TOKENS)})"


def _standard(x: str) -> str:
    return f"regexp_matches({x}, '^_*{Q._standard}(?:_+{Q._standard})+_*$')"


def _templated(x: str) -> str:
    parts = f"list_filter(string_split({x}, '_'), lambda p: p <> '')"
    labels = D.sql_list([label for label, _ in V.DOC_TYPES] + [label for label, _ in V.ISSUERS])
    known = _some(parts, "p", f"p IN {labels} OR regexp_matches(p, '^\\d{{4}}(?:-\\d{{2}}){{0,2}}$')")
    return f"coalesce(len({parts}) BETWEEN 2 AND 6 AND regexp_matches({parts}[1], '^[A-Z][A-Za-z0-9]+$') AND {known}, false)"


_n = "len(tidy_useful)"
_phrase = _some("tidy_chunks", "c", "contains(c, '_')")
ENOUGH = f"""({_n} <= 1 OR ({_n} >= 3 AND NOT (tidy_type IS NOT NULL AND NOT {_in('tidy_type', V.GENERIC_TYPES)}) AND tidy_form IN ('artifact', 'title', 'record')
  AND NOT {_phrase}) OR ({_n} >= 3 AND {_in('tidy_type', V.TITLE_TYPES + ['Policy', 'Application'])} AND tidy_form IN ('title', 'record'))
 OR ({_n} = 2 AND tidy_form = 'record' AND {_some('tidy_useful', 'x', "regexp_matches(x, '^[A-Za-z]{1,3}$')")}))"""
_doubled = "regexp_matches(base, '__|--|\\.\\.')"
REASON = f"""CASE WHEN base = '' THEN 'empty' WHEN {_in('ext', V.CONFIG_EXT)} THEN 'config_file'
 WHEN regexp_matches(lower(base), '{'|'.join(V.WEAK_NAMES)}') THEN 'weak_name'
 WHEN {_standard('base')} OR {_standard('clean')} OR {_templated('twice')} THEN 'already_standard'
 WHEN clean <> base AND {ENOUGH} THEN 'suffix_only'
 WHEN {_in('doc_type', V.TITLE_TYPES)} AND len(useful) <= 3 AND NOT regexp_matches(text, '\\d') THEN 'short_title'
 WHEN {_in('ext', V.MEDIA_EXT)} AND len(useful) >= 5 THEN 'media_title'
 WHEN NOT {_any('base', V.NOISE_TOKENS)} AND len(useful) >= 3 AND NOT contains(base, ' ') AND NOT {_doubled} THEN 'readable'
 WHEN NOT (regexp_matches(base, '[ ()\\[\\]%]') OR {_doubled} OR {_any('lower(base)', V.RAW_NAMES)}) THEN 'no_noise'
 WHEN len(w) = 0 THEN 'no_words' END"""
_raw = "replace(x, '_', ' ')"
_small = _COMPACT.format(x="x")
_meets = "(contains({a}, {b}) OR contains({b}, {a}))".format
ANCHORS = f"""list_transform(list_filter(go_phrases, lambda x: NOT (lower({_raw}) IN {D.sql_list(V.BENIGN_SUFFIXES)} OR {_any(_raw, V.NOISE_TOKENS)})
 AND NOT (regexp_matches({_raw}, '^\\d{{4}}(?:-\\d{{2}}){{0,2}}$') OR regexp_matches(lower({_raw}), '^(rev|v|part|module|lec)'))
 AND (coalesce({_meets(a='lower(typ)', b=_small)}, false) OR {_CODE.format(x=_raw)} OR {Q._upper.format(x=_raw)} OR contains(x, '_'))), lambda x: {_small})"""
_repeats = f"(NOT {_small} = 'version' AND coalesce({_small} = lower(doc_type), false))"
_has_phrase = _some("chunks", "c", "contains(c, '_')")
LIGHT = f"""CASE WHEN NOT (clean = base AND (chunks = w OR NOT {_some('chunks', 'c', "regexp_matches(c, '[0-9]')")})) AND form <> 'weak'
 AND len(light_parts) BETWEEN 1 AND 5 THEN nullif({_EDGES.format(x="array_to_string(light_parts, '_')")}, '') END"""


def _keeps(candidate: str, stage: str) -> str:
    """CTEs that add ``<candidate>_ok`` to a stage."""
    meets = lambda a, b: _meets(a=a, b=b)
    covered = f"len(list_filter(terms, lambda t: {_some('parts', 'p', meets('t', 'p'))}))"
    lenient = _in("pattern_class", V.LENIENT_CLASSES)
    first = f"list_transform(useful[1:2], lambda x: {_small})"
    return f"""{candidate}_w AS (SELECT *, {Q.WORDS.format(x=candidate)} AS cw FROM {stage}),
{candidate}_p AS (SELECT *, list_transform(cw, lambda x: {_small}) AS parts, list_transform({_paired('cw')}, lambda x: {_small}) AS phrases FROM {candidate}_w),
{candidate}_k AS (SELECT * EXCLUDE (cw, parts, phrases), coalesce({candidate} IS NOT NULL AND len(cw) > 0
 AND {_every('anchors', 'a', _some('phrases', 'c', meets('a', 'c')))}
 AND (len(terms) = 0 OR CASE WHEN {lenient} THEN {covered} > 0 ELSE {covered} >= len(terms) * 0.45 END)
 AND (typ IS NULL OR {_some('parts', 'p', meets('p', 'lower(typ)'))})
 AND (NOT titled OR {_every(first, 't', _some('parts[1:3]', 'c', meets('t', 'c')))}), false) AS {candidate}_ok FROM {candidate}_p)"""


_said = f"coalesce({_small} IN (lower(typ), lower(issuer), lower(version), replace(doc_date, '-', '')), false)"
_number = f"({_in('typ', ['Module', 'Lecture'])} AND regexp_matches(lower(x), '^(module|lecture)\\d+$') AND coalesce(starts_with(lower(x), lower(typ)), false))"
TOPIC = f"""nullif(array_to_string(list_transform(list_filter(own_chunks, lambda x: lower(x) NOT IN {D.sql_list(V.NAME_STOPWORDS)} AND NOT {_said}
 AND NOT {_number})[1:CASE WHEN titled THEN 5 ELSE 3 END], lambda x: {Q.FORMAT}), '_'), '')"""
_has = "list_contains(low, '{}')".format
_level = "low[list_position(low, 'level') + 1]"
ARTIFACT = f"""CASE WHEN {_has('floor')} AND {_has('plan')} THEN CASE WHEN {_has('level')} AND coalesce(regexp_matches({_level}, '^\\d+$'), false)
  THEN concat('FloorPlan_Level', {_level}) ELSE 'FloorPlan' END
 WHEN {_has('model')} THEN 'Model' WHEN {_has('layout')} THEN 'Layout' WHEN {_has('design')} AND {_has('plot')} THEN 'PlotDesign'
 WHEN {_has('report')} THEN 'Report' END"""
SHOWN = f"CASE WHEN length(id) <= 12 THEN upper(id) ELSE {Q._pascal.replace('(y', '(id').replace('(y,', '(id,').replace('THEN y', 'THEN id').replace('y[', 'id[')} END"
_in_date = f"coalesce(contains({_COMPACT.format(x='doc_date')}, {_COMPACT.format(x='shown')}), false)"
ROLES = {
    "name": "NULL", "type": "CASE WHEN NOT coalesce(typ = 'Module' AND starts_with(lower(version), 'module'), false) THEN typ END", "issuer": "issuer",
    "date": "doc_date", "version": "version", "status": "status", "topic": "topic", "project": "project",
    "subject": "coalesce(artifact, CASE WHEN topic IS DISTINCT FROM project THEN topic END)", "artist": "NULL", "title": "topic",
    "part": "CASE WHEN starts_with(version, 'Part') THEN version END", "id": f"CASE WHEN NOT {_in_date} THEN shown END", "name_or_topic": "topic",
}


def _assembled() -> str:
    arms = []
    for label, (_, _, order, required) in V.PATTERN_CLASSES.items():
        complete = " AND ".join(f"({ROLES[r]}) IS NOT NULL" for r in required)
        arms.append(f"WHEN pattern_class = '{label}' AND {complete} THEN list_filter([{', '.join(f'({ROLES[r]})::VARCHAR' for r in order)}], lambda x: x IS NOT NULL)")
    return "CASE WHEN NOT attempt THEN NULL " + " ".join(arms) + " END"


def standard_sql(plain: str) -> str:
    """The whole chain over CTEs that end in ``plain``: doc_id, lang, source, name, base, ext."""
    first = lambda items: f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
    return f"""WITH {plain},
s0 AS (SELECT *, {Q.CLEAN} AS clean, {Q.WORDS.format(x='base')} AS w FROM plain),
s1 AS (SELECT *, {Q.CLEAN.replace('(base,', '(clean,')} AS twice, array_to_string(w, ' ') AS text, {_useful('w')} AS useful,
  CASE WHEN clean <> base THEN {Q.WORDS.format(x='clean')} END AS tidy FROM s0),
s2 AS (SELECT *, {_type('text')} AS doc_type, array_to_string(tidy, ' ') AS tidy_text, {_counted('tidy')} AS tidy_m, {_useful('tidy')} AS tidy_useful FROM s1),
s3 AS (SELECT *, {_paired('tidy_m')} AS tidy_chunks, CASE WHEN tidy IS NOT NULL THEN {_type('tidy_text')} END AS tidy_type FROM s2),
s4 AS (SELECT *, {_form('tidy_chunks', 'tidy_type')} AS tidy_form FROM s3),
s5 AS (SELECT *, {REASON} AS reason, replace(base, '%20', ' ') AS raw FROM s4),
s6 AS (SELECT *, reason IS NULL AS kept, CASE WHEN reason IS NULL THEN w END AS go, CASE WHEN reason IS NULL THEN {Q.CLASS} END AS pattern_class,
  CASE WHEN reason IS NULL THEN {Q._label('text', V.ISSUERS)} END AS issuer, CASE WHEN reason IS NULL THEN {Q._label('text', V.STATUSES)} END AS status,
  CASE WHEN reason IS NULL THEN {Q.DATE} END AS doc_date, CASE WHEN reason IS NULL THEN {Q.VERSION.replace('(raw,', '(base,')} END AS version,
  CASE WHEN doc_type NOT IN {D.sql_list(V.GENERIC_TYPES)} THEN doc_type END AS typ FROM s5),
s7 AS (SELECT *, {_counted('go')} AS own_m, {_paired('go')} AS go_phrases,
  {_in('ext', V.MEDIA_EXT)} OR ({_in('typ', V.TITLE_TYPES)} AND {_some('go', 'x', f"lower(x) IN {D.sql_list(V.TITLE_MARKERS)}")}) AS titled,
  list_distinct(list_transform(useful, lambda x: lower(x))) AS terms FROM s6),
s8 AS (SELECT *, {_paired('own_m')} AS own_chunks, {ANCHORS} AS anchors FROM s7),
s9 AS (SELECT *, CASE WHEN kept THEN coalesce(tidy_chunks, own_chunks) END AS chunks FROM s8),
s10 AS (SELECT *, {_form('chunks', 'doc_type')} AS form, list_transform(chunks, lambda x: {Q.FORMAT}) AS formatted FROM s9),
s11 AS (SELECT *, CASE WHEN {_has_phrase} THEN list_filter(formatted, lambda x: NOT {_repeats}) ELSE formatted END AS some_parts FROM s10),
s12 AS (SELECT *, {first('some_parts')} AS light_parts FROM s11),
s13 AS (SELECT *, {LIGHT} AS light FROM s12),
{_keeps('light', 's13')},
s14 AS (SELECT *, coalesce(kept AND NOT light_ok AND NOT {_in('doc_type', V.GENERIC_TYPES)} AND pattern_class IS NOT NULL, false) AS attempt FROM light_k),
s15 AS (SELECT *, CASE WHEN attempt THEN {TOPIC} END AS topic, CASE WHEN attempt THEN list_transform(go, lambda x: lower(x)) END AS low,
  CASE WHEN attempt THEN nullif(regexp_extract(text, '\\b([A-Za-z]{{0,4}}\\d{{4,}}[A-Za-z0-9]*)\\b', 1), '') END AS id FROM s14),
s16 AS (SELECT *, CASE WHEN {_in('ext', V.TECHNICAL_EXT)} OR pattern_class = 'technical_project' THEN topic END AS project, {ARTIFACT} AS artifact,
  CASE WHEN id IS NOT NULL THEN {SHOWN} END AS shown FROM s15),
s17 AS (SELECT *, {_assembled()} AS assembled FROM s16),
s18 AS (SELECT *, list_transform(assembled, lambda x: lower(x)) AS folded FROM s17),
s19 AS (SELECT *, list_filter(assembled, lambda x, i: list_position(folded, folded[i]) = i) AS uniq FROM s18),
s20 AS (SELECT *, CASE WHEN len(uniq) >= 2 AND array_to_string(uniq[1:5], '_') <> base THEN array_to_string(uniq[1:5], '_') END AS role FROM s19),
{_keeps('role', 's20')},
done AS (SELECT *, CASE WHEN light_ok THEN light WHEN role_ok THEN role END AS proposed FROM role_k)
SELECT doc_id, lang, source, name, {_EDGES.format(x=f'substring(proposed, 1, {V.MAX_NAME})')} AS proposed_base, doc_type, issuer, status, doc_date, version, pattern_class,
 CASE WHEN proposed IS NULL THEN coalesce(reason, 'no_safe_candidate') END AS skip_reason FROM done"""


_PARTS = f"SELECT p_partkey AS doc_id, p_brand AS lang, p_type AS source, {D.PART_NAME} AS name FROM part"
ORACLES = {"standard_names": standard_sql(Q.PLAIN), "standard_part_names": standard_sql(Q.PLAIN.replace(D.PLAIN, _PARTS))}
