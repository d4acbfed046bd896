"""SQL fragments that state the column rules for DuckDB, written apart from the engine."""

from __future__ import annotations

from rolecall.functions.identity import NAME_NOISE
from rolecall.workload.tables import CONFIG, ENTITIES, POSTINGS, duck

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{SPACE}', ' ', 'g')), '')"


def number(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({x}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
        f"THEN TRY_CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS INTEGER) END"
    )


def decimal(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace({x}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"


def name_key(x: str) -> str:
    noise = "|".join(NAME_NOISE)
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), "
        f"'\\b({noise})\\b', ' ', 'g'), ' +', ' ', 'g'))"
    )


def domain(x: str) -> str:
    bare = f"regexp_replace(lower(trim({x})), '^(http://)?(https://)?(www[.])?', '')"
    return f"nullif(trim(split_part({bare}, '/', 1)), '')"


def host(x: str) -> str:
    return f"nullif(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 2), '')"


def link(x: str) -> str:
    """Canonical link, for links without percent signs or plus signs."""
    u = clean(x)
    pattern = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+)([^?#]*)([?]([^#]*))?"
    part = lambda i: f"regexp_extract({u}, '{pattern}', {i})"
    authority = (
        f"CASE WHEN lower({part(1)}) = 'http' THEN regexp_replace(lower({part(2)}), ':80$', '') "
        f"WHEN lower({part(1)}) = 'https' THEN regexp_replace(lower({part(2)}), ':443$', '') ELSE lower({part(2)}) END"
    )
    path = (
        f"CASE WHEN {part(3)} = '' OR {part(3)} = '/' THEN '/' ELSE regexp_replace({part(3)}, '/+$', '') END"
    )
    kept = (
        f"list_sort(list_filter(list_transform(list_filter(string_split({part(5)}, '&'), lambda q: q <> ''), "
        "lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END), "
        "lambda q: NOT starts_with(lower(q), 'utm_') AND lower(split_part(q, '=', 1)) NOT IN "
        "('gclid', 'fbclid', 'ref', 'ref_src', 'source', 'trk', 'mkt_tok')))"
    )
    query = f"coalesce(array_to_string({kept}, '&'), '')"
    whole = (
        f"lower({part(1)}) || '://' || ({authority}) || ({path}) || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"
    )
    return f"CASE WHEN regexp_matches({u}, '{pattern}') THEN {whole} ELSE rtrim({u}, '/') END"


def tier(x: str) -> str:
    return f"CASE {x} WHEN 'company_careers' THEN 1 WHEN 'greenhouse' THEN 2 ELSE 3 END"


def span(low: str, high: str) -> str:
    side = lambda c: f"coalesce(CAST({c} AS VARCHAR), '?')"
    return (
        f"CASE WHEN {low} IS NULL AND {high} IS NULL THEN 'Not listed' "
        f"ELSE {side(low)} || '-' || {side(high)} || ' yrs' END"
    )


def word(text: str, keyword: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9]){keyword.lower()}([^a-z0-9]|$)')"


_NOT_PLACES = "('remote', 'hybrid', 'onsite', 'on-site', 'anywhere', 'worldwide', 'virtual')"
_PARTS = "list_filter(list_transform(string_split(location, ','), lambda x: trim(x)), lambda x: x <> '')"
_BLOB = "lower(concat_ws(' ', location, raw_description, raw_title))"

#: ``norm``: the postings after every column rule.
NORM = f"""
raw AS ({duck(POSTINGS)}),
cleaned AS (SELECT seq, source, mode, company_hint, company_domain, {clean('source_job_id')} AS source_job_id,
 coalesce({clean('company_name')}, {clean('company_hint')}, '') AS company_name,
 coalesce({clean('title')}, '') AS title, {clean('location')} AS location, lower({clean('remote_status')}) AS stated,
 nullif(trim(regexp_replace(lower({clean('employment_type')}), '[^a-z0-9]+', '_', 'g'), '_'), '') AS employment_type,
 {number('experience_min')} AS lo, {number('experience_max')} AS hi, {clean('url')} AS source_url,
 {link('url')} AS canonical_url, {clean('description')} AS description, description AS raw_description, title AS raw_title,
 coalesce(list_filter(list_transform(regexp_split_to_array(skills, '[,;|]'), lambda s: {clean('s')}), lambda s: s IS NOT NULL), []) AS skills,
 {decimal('salary_max')} AS salary_max,
 CASE WHEN regexp_matches(posted_date, '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}$') THEN replace(posted_date, '/', '-') || 'T00:00:00' END AS posted_date
 FROM raw),
placed AS (SELECT *, {_PARTS} AS parts,
 CASE WHEN stated IN ('remote', 'fully remote', 'work from home', 'wfh') THEN 'remote' WHEN stated = 'hybrid' THEN 'hybrid'
  WHEN stated IN ('onsite', 'on-site', 'in-office', 'in office', 'office') THEN 'onsite'
  WHEN contains({_BLOB}, 'hybrid') THEN 'hybrid'
  WHEN contains({_BLOB}, 'remote') OR contains({_BLOB}, 'work from home') OR contains({_BLOB}, 'wfh') OR contains({_BLOB}, 'anywhere') THEN 'remote'
  ELSE 'unknown' END AS remote_status,
 CASE WHEN lo > hi THEN hi ELSE lo END AS experience_min, CASE WHEN lo > hi THEN lo ELSE hi END AS experience_max FROM cleaned),
norm AS (SELECT *,
 CASE WHEN len(parts) >= 2 AND lower(parts[1]) NOT IN {_NOT_PLACES} THEN parts[1] END AS city,
 CASE WHEN len(parts) >= 2 AND lower(parts[-1]) NOT IN {_NOT_PLACES} THEN parts[-1] END AS country,
 sha256(concat_ws('|', {name_key('company_name')}, trim(lower(title)), trim(lower(coalesce(location, ''))),
  coalesce(CAST(experience_min AS VARCHAR), ''), coalesce(CAST(experience_max AS VARCHAR), ''))) AS content_hash
 FROM placed)"""

#: ``matched``: ``norm`` with the entity found by name, else by domain.
MATCHED = f"""{NORM},
entities AS ({duck(ENTITIES)}),
by_name AS (SELECT {name_key('name')} AS key, arg_min(name, (priority, name)) AS hit, arg_min(entity_id, (priority, name)) AS hit_id
 FROM entities GROUP BY 1),
by_domain AS (SELECT {domain('domain')} AS key, arg_min(name, (priority, name)) AS hit, arg_min(entity_id, (priority, name)) AS hit_id
 FROM entities GROUP BY 1),
matched AS (SELECT norm.*, coalesce(b.hit, d.hit) AS target_match, coalesce(b.hit_id, d.hit_id) AS entity_id,
 CASE WHEN coalesce(b.hit, d.hit) IS NULL THEN 'NONE' ELSE 'HIGH' END AS match_confidence
 FROM norm LEFT JOIN by_name b ON b.key <> '' AND b.key = {name_key('norm.company_name')}
 LEFT JOIN by_domain d ON d.key = coalesce({domain('norm.company_domain')}, {domain(host('norm.source_url'))}))"""


def _roles() -> tuple[str, str]:
    full = " ".join(f"WHEN contains(lower(title), '{r}') THEN '{r}'" for r in CONFIG.roles)
    partial = []
    for role in reversed(CONFIG.roles):
        words = sorted(set(role.split()))
        hits = " + ".join(f"CAST(list_contains(words, '{w}') AS INTEGER)" for w in words)
        partial.append(f"WHEN ({hits}) * 2 >= {len(words)} THEN '{role}'")
    return f"CASE {full} END", f"CASE {' '.join(partial)} END"


def _present(skill: str) -> str:
    return f"(list_contains(low_skills, '{skill}') OR {word('body', skill)})"


def _list(names: tuple[str, ...], negate: bool = False) -> str:
    items = ", ".join(
        f"CASE WHEN {'NOT ' if negate else ''}{_present(s)} THEN '{s}' END" for s in names
    )
    return f"list_filter([{items}], lambda s: s IS NOT NULL)"


_FULL_ROLE, _PART_ROLE = _roles()
_HAY = "concat_ws(' ', nullif(lower(location), ''), nullif(lower(city), ''))"
_PLACES = " OR ".join(f"contains(hay, '{p}')" for p in ("asia", "nation_7", "nation_3"))

#: ``leveled``: ``matched`` with every match level.
LEVELED = f"""{MATCHED},
words AS (SELECT *, regexp_extract_all(lower(title), '\\w+') AS words, list_transform(skills, lambda s: lower(s)) AS low_skills,
 lower(coalesce(description, '')) AS body, {_HAY} AS hay, {span('experience_min', 'experience_max')} AS experience_text FROM matched),
leveled AS (SELECT *,
 CASE WHEN title = '' THEN 'UNKNOWN' WHEN {_FULL_ROLE} IS NOT NULL THEN 'FULL' WHEN {_PART_ROLE} IS NOT NULL THEN 'PARTIAL' ELSE 'NONE' END AS title_level,
 CASE WHEN title <> '' THEN coalesce({_FULL_ROLE}, {_PART_ROLE}) END AS role,
 CASE WHEN {_PLACES} THEN 'FULL' WHEN remote_status = 'remote' OR contains(hay, 'remote') THEN 'FULL' WHEN hay = '' THEN 'UNKNOWN'
  WHEN contains(lower(country), 'europe') OR contains('europe', lower(country)) THEN 'PARTIAL' WHEN country IS NULL THEN 'UNKNOWN' ELSE 'NONE' END AS location_level,
 CASE WHEN experience_min IS NULL AND experience_max IS NULL THEN 'UNKNOWN'
  WHEN coalesce(experience_min, -1) <= 6 AND coalesce(experience_max, 99) >= 3 THEN 'FULL' ELSE 'NONE' END AS experience_level,
 CASE WHEN employment_type IS NULL THEN 'UNKNOWN' WHEN employment_type IN ('full_time', 'contract') THEN 'FULL' ELSE 'NONE' END AS employment_level,
 {_list(CONFIG.skills)} AS skills_found, {_list(CONFIG.skills, True)} AS skills_missing, {_list(CONFIG.preferred_skills)} AS preferred_found,
 len(skills) > 0 OR body <> '' AS has_skill_data,
 CASE WHEN contains(lower(title), 'promo') THEN 'promo' END AS excluded_hit
 FROM words)"""

_FAILS = """CASE WHEN target_match IS NULL THEN 'Not a target company'
 WHEN excluded_hit IS NOT NULL THEN 'Excluded keyword: ' || excluded_hit
 WHEN title_level = 'NONE' THEN 'No role match for ''' || title || ''''
 WHEN location_level = 'NONE' THEN 'Location not in list: ' || coalesce(location, 'unknown')
 WHEN experience_level = 'NONE' THEN 'Experience ' || experience_text || ' outside 3-6 yrs'
 WHEN employment_level = 'NONE' THEN 'Employment type not wanted: ' || employment_type
 {skills} END"""
FAIL_ANY = _FAILS.format(
    skills="WHEN len(skills_found) < 1 AND has_skill_data THEN 'Only ' || CAST(len(skills_found) AS VARCHAR) || '/1 required skills matched'"
)
FAIL_ALL = _FAILS.format(
    skills="WHEN len(skills_missing) > 0 THEN 'Missing required skills: ' || array_to_string(skills_missing, ', ')"
)
NOTES = """concat_ws(' & ',
 CASE title_level WHEN 'FULL' THEN 'Role match: ' || role WHEN 'PARTIAL' THEN 'Partial role match: ' || role WHEN 'UNKNOWN' THEN 'Title missing - role not verified' END,
 CASE location_level WHEN 'FULL' THEN 'Location match: ' || coalesce(location, 'remote') WHEN 'UNKNOWN' THEN 'Location not listed' END,
 CASE experience_level WHEN 'FULL' THEN 'Experience match: ' || experience_text WHEN 'UNKNOWN' THEN 'Experience not listed' END,
 CASE WHEN employment_level = 'FULL' THEN 'Employment type match: ' || employment_type END,
 CASE WHEN len(skills_found) < 1 THEN 'Skills not listed' ELSE 'Skills matched: ' || array_to_string(skills_found, ', ') END)"""

#: ``scored``: ``leveled`` with verdict, score, reasons and warnings.
SCORED = f"""{LEVELED},
scored AS (SELECT *, {FAIL_ANY} AS reject_reason,
 CAST(round_even(100.0 * (
  30.0 * CASE title_level WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.6 WHEN 'UNKNOWN' THEN 0.5 ELSE 0.0 END
  + 30.0 * CASE WHEN NOT has_skill_data THEN 0.5 ELSE (len(skills_found) + 0.5 * len(preferred_found)) / 4.5 END
  + 20.0 * CASE experience_level WHEN 'FULL' THEN 1.0 WHEN 'UNKNOWN' THEN 0.5 ELSE 0.0 END
  + 15.0 * CASE location_level WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'UNKNOWN' THEN 0.5 ELSE 0.0 END
  + 5.0 * CASE WHEN employment_level = 'FULL' THEN 1.0 WHEN employment_level = 'UNKNOWN' THEN 0.5 ELSE 0.0 END) / 100, 0) AS INTEGER) AS match_score,
 concat_ws(' & ',
  CASE title_level WHEN 'FULL' THEN 'Exact role match: ' || role WHEN 'PARTIAL' THEN 'Partial role match: ' || role END,
  CASE WHEN has_skill_data AND len(skills_found) > 0 THEN 'Skills matched: ' || array_to_string(skills_found, ', ') END,
  CASE WHEN has_skill_data AND len(preferred_found) > 0 THEN 'Preferred skills matched: ' || array_to_string(preferred_found, ', ') END,
  CASE WHEN experience_level = 'FULL' THEN 'Experience ' || experience_text || ' matches 3-6' END,
  CASE location_level WHEN 'FULL' THEN CASE WHEN remote_status = 'remote' THEN 'Remote role' ELSE 'Location match: ' || location END
   WHEN 'PARTIAL' THEN 'Country-level location match: ' || country END,
  CASE WHEN employment_level = 'FULL' THEN 'Employment type match: ' || employment_type END) AS reasons,
 concat_ws(' & ',
  CASE WHEN title_level = 'UNKNOWN' THEN 'Title missing' END,
  CASE WHEN NOT has_skill_data THEN 'Skills not listed' WHEN len(skills_missing) > 0 THEN 'Required skills not listed: ' || array_to_string(skills_missing, ', ') END,
  CASE experience_level WHEN 'UNKNOWN' THEN 'Experience not listed' WHEN 'NONE' THEN 'Experience ' || experience_text || ' outside 3-6 yrs' END,
  CASE WHEN location_level = 'UNKNOWN' THEN 'Location not listed' END,
  CASE WHEN employment_level = 'UNKNOWN' THEN 'Employment type not listed' END,
  CASE WHEN salary_max IS NULL THEN 'Salary unavailable' END) AS warnings
 FROM leveled)"""


def replay(rows: str) -> str:
    """``folded``: the sequential rule, one row after another. ``rows`` names a table (ord, job_new, source, sid,
    url, raw, hash) in order of ``ord``; a row that starts a record gives it the id ``job_new``.

    Rows without a common key, direct or by way of others, never look at one another, so each such set (``part``)
    is folded by itself: a recursion whose state is the list of its records and the list of its references.
    """
    empty_jobs = "[]::STRUCT(job BIGINT, source VARCHAR, sid VARCHAR, url VARCHAR, hash VARCHAR, tier INTEGER)[]"
    empty_refs = "[]::STRUCT(job BIGINT, source VARCHAR, sid VARCHAR, raw VARCHAR)[]"
    first = lambda table, test: f"list_filter({table}, lambda x: {test})[1].job"
    least = lambda table, test: f"list_min(list_transform(list_filter({table}, lambda x: {test}), lambda x: x.job))"
    return f"""
keys AS (SELECT ord, concat('i', source, chr(1), sid) AS key FROM {rows} WHERE sid IS NOT NULL
 UNION SELECT ord, 'u' || url FROM {rows} WHERE url IS NOT NULL UNION SELECT ord, 'u' || raw FROM {rows} WHERE raw IS NOT NULL
 UNION SELECT ord, 'h' || hash FROM {rows}),
star AS (SELECT k.ord, m.hub FROM keys k JOIN (SELECT key, min(ord) AS hub FROM keys GROUP BY key) m USING (key)),
edges AS MATERIALIZED (SELECT ord AS a, hub AS b FROM star UNION SELECT hub, ord FROM star),
reach AS (SELECT ord, ord AS other FROM {rows} UNION SELECT r.ord, e.b FROM reach r JOIN edges e ON e.a = r.other),
parts AS (SELECT ord, min(other) AS part FROM reach GROUP BY ord),
queue AS MATERIALIZED (SELECT r.*, {tier('source')} AS tier, part, row_number() OVER (PARTITION BY part ORDER BY r.ord) AS i
 FROM {rows} r JOIN parts p ON p.ord = r.ord),
fold AS (
 SELECT DISTINCT part, 0::BIGINT AS i, {empty_jobs} AS jobs, {empty_refs} AS refs,
  NULL::BIGINT AS ord, NULL::BIGINT AS job, NULL::BOOLEAN AS is_new, NULL::BOOLEAN AS promoted FROM queue
 UNION ALL
 SELECT part, i,
  CASE WHEN is_new THEN list_append(jobs, struct_pack(job := job, source := source, sid := sid, url := url, hash := hash, tier := tier))
   WHEN promoted THEN list_transform(jobs, lambda x: CASE WHEN x.job = job
    THEN struct_pack(job := x.job, source := source, sid := sid, url := coalesce(url, raw), hash := x.hash, tier := tier) ELSE x END)
   ELSE jobs END,
  CASE WHEN len(list_filter(refs, lambda x: x.job = job AND x.source = source AND x.sid = coalesce(sid, ''))) = 0
   THEN list_append(refs, struct_pack(job := job, source := source, sid := coalesce(sid, ''), raw := raw))
   WHEN raw IS NOT NULL THEN list_transform(refs, lambda x: CASE WHEN x.job = job AND x.source = source AND x.sid = coalesce(sid, '')
    THEN struct_pack(job := x.job, source := x.source, sid := x.sid, raw := raw) ELSE x END)
   ELSE refs END,
  ord, job, is_new, promoted
 FROM (SELECT *, coalesce(hit, job_new) AS job, hit IS NULL AS is_new,
   coalesce(tier < list_filter(jobs, lambda x: x.job = hit)[1].tier, FALSE) AS promoted
  FROM (SELECT q.part, q.i, q.ord, q.job_new, q.source, q.sid, q.url, q.raw, q.hash, q.tier, f.jobs, f.refs, coalesce(
    CASE WHEN q.sid IS NOT NULL THEN coalesce({least('f.refs', 'x.source = q.source AND x.sid = q.sid')}, {least('f.jobs', 'x.source = q.source AND x.sid = q.sid')}) END,
    CASE WHEN q.url IS NOT NULL THEN coalesce({least('f.jobs', 'x.url = q.url')}, {first('f.refs', 'x.raw = q.url')}) END,
    {least('f.jobs', 'x.hash = q.hash')}) AS hit
   FROM fold f JOIN queue q ON q.part = f.part AND q.i = f.i + 1))),
folded AS (SELECT ord, job, is_new, promoted FROM fold WHERE i > 0)"""
