"""Match levels, the ordered filter, scores and look-ups."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.config import SearchConfig
from rolecall.operators import predicates as pred
from rolecall.operators.aggregates import run_counters
from rolecall.operators.identity import lookup_identity
from rolecall.operators.match import attach_context, best_links, match_entities, with_priority
from rolecall.operators.normalize import normalize_postings
from rolecall.operators.score import with_score
from rolecall.operators.upsert import changed
from rolecall.session import stage
from rolecall.workload import sqltext as q
from rolecall.workload.catalog import query
from rolecall.workload.tables import CONFIG, ENTITIES, SIGHTINGS, TRACKING, Tables, duck

MANY = " & "


def matched(t: Tables) -> DataFrame:
    return match_entities(normalize_postings(t.postings), t.entities)


def leveled(t: Tables) -> DataFrame:
    return pred.with_levels(matched(t), CONFIG)


def judged(t: Tables, cfg: SearchConfig) -> DataFrame:
    """Verdicts of all postings. Texts are searched before the rows meet entities: no join moves them."""
    rows = pred.searched(normalize_postings(t.postings), cfg).drop("description", "search_text")
    return pred.ordered_filter(match_entities(rows, t.entities), cfg)


def _from_leveled(columns: str) -> str:
    return f"WITH {q.LEVELED} SELECT {columns} FROM leveled"


@query("entity_match", f"WITH {q.MATCHED} SELECT seq, target_match, entity_id, match_confidence FROM matched")
def entity_match(t: Tables) -> DataFrame:
    return matched(t).select("seq", "target_match", "entity_id", "match_confidence")


@query(
    "context_match",
    f"""WITH {q.MATCHED}, told AS (SELECT m.seq, b.hit AS ctx, m.target_match FROM matched m
 LEFT JOIN raw r ON r.seq = m.seq LEFT JOIN by_name b ON r.mode = 'company' AND b.key <> ''
 AND b.key = {q.name_key("coalesce(nullif(r.company_hint, ''), r.company_name)")})
SELECT seq, coalesce(ctx, target_match) AS target_match, ctx IS NOT NULL AS from_context FROM told""",
)
def context_match(t: Tables) -> DataFrame:
    rows = normalize_postings(attach_context(t.postings, t.entities))
    return match_entities(rows, t.entities).select(
        "seq", "target_match", F.col("context_name").isNotNull().alias("from_context")
    )


@query("title_level", _from_leveled("seq, title, title_level, role"))
def title_level(t: Tables) -> DataFrame:
    return leveled(t).select("seq", "title", "title_level", "role")


@query("location_level", _from_leveled("seq, location_level"))
def location_level(t: Tables) -> DataFrame:
    return leveled(t).select("seq", "location_level")


@query(
    "experience_overlap",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 AND p_size % 5 = 0 THEN 'UNKNOWN'
 WHEN coalesce(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END, -1) <= 6
  AND coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size + 2 END, 99) >= 3 THEN 'FULL' ELSE 'NONE' END AS level FROM part""",
)
def experience_overlap(t: Tables) -> DataFrame:
    low = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    high = F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 2)
    return t.part.select("p_partkey", pred.experience_level(low, high, CONFIG).alias("level"))


@query("employment_level", _from_leveled("seq, employment_level"))
def employment_level(t: Tables) -> DataFrame:
    return leveled(t).select("seq", "employment_level")


_WORDS = ("the", "der", "que", "les", "or")


@query(
    "keyword_hits",
    "SELECT doc_id, " + ", ".join(f"{q.word('lower(text)', w)} AS has_{w}" for w in _WORDS) + " FROM documents",
)
def keyword_hits(t: Tables) -> DataFrame:
    low = t.documents.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", *[pred.has_keyword(F.col("low"), w).alias(f"has_{w}") for w in _WORDS])


# Keywords in a table: pairs of neighbouring words of many documents, all part types and words with signs.
_KEYWORDS = """
SELECT DISTINCT keyword FROM (
 SELECT concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 4)) AS keyword FROM {documents} WHERE doc_id % 10 = 0
 UNION ALL SELECT split_part(text, ' ', 2) FROM {documents} WHERE doc_id % 7 = 0
 UNION ALL SELECT p_type FROM {part} UNION ALL SELECT concat(p_brand, '.js') FROM {part} UNION ALL SELECT '--' UNION ALL SELECT '(') x
"""


@query(
    "keyword_table",
    f"""WITH k AS (SELECT DISTINCT keyword FROM ({duck(_KEYWORDS)}) WHERE keyword <> ''), d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)
SELECT doc_id, keyword FROM d JOIN k ON contains(low, lower(keyword))
WHERE regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(lower(keyword)) || '([^a-z0-9]|$)')""",
)
def keyword_table(t: Tables) -> DataFrame:
    """Which of many keywords stand in which documents."""
    return pred.keyword_table_hits(t.documents, t.sql(_KEYWORDS), "doc_id")


def _joined(*columns: str) -> list:
    return [F.array_join(c, ",").alias(c) for c in columns]


@query(
    "skill_report",
    _from_leveled(
        "seq, has_skill_data, " + ", ".join(
            f"array_to_string({c}, ',') AS {c}" for c in ("skills_found", "skills_missing", "preferred_found"))
    ),
)
def skill_report(t: Tables) -> DataFrame:
    return leveled(t).select("seq", "has_skill_data", *_joined("skills_found", "skills_missing", "preferred_found"))


_WIDE = dataclasses.replace(
    CONFIG, excluded_keywords=("urgent", "promo", "ning"), excluded_keyword_fields=("title", "description")
)


@query(
    "excluded_keyword",
    f"""WITH {q.NORM}, b AS (SELECT seq, lower(concat_ws(chr(10), nullif(title, ''), description)) AS blob FROM norm)
SELECT seq, CASE WHEN contains(blob, 'urgent') THEN 'urgent' WHEN contains(blob, 'promo') THEN 'promo'
 WHEN contains(blob, 'ning') THEN 'ning' END AS hit FROM b""",
)
def excluded_keyword(t: Tables) -> DataFrame:
    return normalize_postings(t.postings).select(
        "seq", pred.excluded_hit(F.col("title"), F.col("description"), _WIDE, F.col("search_text")).alias("hit")
    )


@query(
    "ordered_filter",
    f"""WITH {q.LEVELED}, f AS (SELECT seq, {q.FAIL_ANY} AS reject_reason, {q.NOTES} AS kept FROM leveled)
SELECT seq, reject_reason IS NULL AS accepted, reject_reason, coalesce(reject_reason, kept) AS notes FROM f""",
)
def ordered_filter(t: Tables) -> DataFrame:
    return judged(t, CONFIG).select(
        "seq", "accepted", "reject_reason", F.array_join("notes", MANY).alias("notes")
    )


_ALL = dataclasses.replace(CONFIG, skill_match_mode="all")


@query(
    "ordered_filter_all_skills",
    f"""WITH {q.LEVELED} SELECT reject_reason, count(*) AS n FROM (SELECT {q.FAIL_ALL} AS reject_reason FROM leveled) GROUP BY 1""",
)
def ordered_filter_all_skills(t: Tables) -> DataFrame:
    return judged(t, _ALL).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "score",
    f"WITH {q.SCORED} SELECT seq, match_score, reasons, warnings FROM scored",
)
def score(t: Tables) -> DataFrame:
    return with_score(leveled(t), CONFIG).select(
        "seq",
        "match_score",
        F.array_join("match_reasons", MANY).alias("reasons"),
        F.array_join("match_warnings", MANY).alias("warnings"),
    )


@query(
    "score_policies",
    f"""WITH {q.LEVELED}, parts AS (SELECT seq, title_level, role, experience_level, location_level, employment_level FROM leveled),
 p AS (SELECT unnest([0.0, 1.0]) AS u)
SELECT seq, u AS unknown_credit, CAST(round_even(100.0 * (
  10.0 * CASE title_level WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.6 WHEN 'UNKNOWN' THEN u ELSE 0.0 END
  + 7.0 * CASE experience_level WHEN 'FULL' THEN 1.0 WHEN 'UNKNOWN' THEN u ELSE 0.0 END
  + 3.0 * CASE location_level WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'UNKNOWN' THEN u ELSE 0.0 END) / 20, 0) AS INTEGER) AS match_score
FROM parts CROSS JOIN p""",
)
def score_policies(t: Tables) -> DataFrame:
    """Other weights and both strict treatments of unknown data."""
    weights = {"title": 10, "skills": 0, "experience": 7, "location": 3, "employment_type": 0}
    rows = leveled(t)
    policies = (("zero", 0.0), ("full", 1.0))
    for policy, _ in policies:
        cfg = dataclasses.replace(CONFIG, weights=weights, unknown_field_policy=policy)
        rows = with_score(rows, cfg).withColumnRenamed("match_score", f"_{policy}")
    # both scores of a row in one pass: a union would derive and level every posting twice
    scores = F.array(*[F.struct(F.lit(u).cast("decimal(2,1)").alias("unknown_credit"), F.col(f"_{p}").alias("match_score")) for p, u in policies])
    return rows.select("seq", F.explode(scores).alias("s")).select("seq", "s.unknown_credit", "s.match_score")


@query(
    "score_accepted",
    f"""WITH {q.SCORED} SELECT seq, CASE WHEN reject_reason IS NULL THEN match_score END AS match_score FROM scored""",
)
def score_accepted(t: Tables) -> DataFrame:
    return with_score(judged(t, CONFIG), CONFIG, only_accepted=True).select("seq", "match_score")


@query(
    "identity_lookup",
    f"""WITH {q.NORM},
 jobs AS (SELECT min(seq) AS job_id, content_hash, arg_min(source, seq) AS source, arg_min(source_job_id, seq) AS source_job_id,
  arg_min(canonical_url, seq) AS canonical_url FROM norm WHERE source = 'indeed' GROUP BY content_hash),
 refs AS (SELECT j.job_id, n.source, n.source_job_id, n.source_url FROM norm n JOIN jobs j USING (content_hash) WHERE n.source = 'greenhouse'),
 r1 AS (SELECT source, source_job_id, min(job_id) AS id FROM refs WHERE source_job_id IS NOT NULL GROUP BY 1, 2),
 r2 AS (SELECT source, source_job_id, min(job_id) AS id FROM jobs WHERE source_job_id IS NOT NULL GROUP BY 1, 2),
 r3 AS (SELECT canonical_url, min(job_id) AS id FROM jobs GROUP BY 1),
 r4 AS (SELECT source_url, min(job_id) AS id FROM refs GROUP BY 1),
 r5 AS (SELECT content_hash, min(job_id) AS id FROM jobs GROUP BY 1)
SELECT n.seq, coalesce(r1.id, r2.id, r3.id, r4.id, r5.id) AS found_id FROM norm n
 LEFT JOIN r1 ON r1.source = n.source AND r1.source_job_id = n.source_job_id
 LEFT JOIN r2 ON r2.source = n.source AND r2.source_job_id = n.source_job_id
 LEFT JOIN r3 ON r3.canonical_url = n.canonical_url LEFT JOIN r4 ON r4.source_url = n.canonical_url
 LEFT JOIN r5 ON r5.content_hash = n.content_hash""",
)
def identity_lookup(t: Tables) -> DataFrame:
    """Every posting against records of one source and references of another."""
    keys = ["seq", "source", "source_job_id", "source_url", "canonical_url", "content_hash"]
    rows = stage(normalize_postings(t.postings).select(*keys), "postings")
    first = F.min_by(F.struct("source", "source_job_id", "canonical_url"), "seq")
    jobs = (
        rows.where(F.col("source") == "indeed")
        .groupBy("content_hash")
        .agg(F.min("seq").alias("job_id"), first.alias("f"))
        .select("job_id", "content_hash", "f.*")
    )
    refs = rows.where(F.col("source") == "greenhouse").join(jobs.select("content_hash", "job_id"), "content_hash")
    return lookup_identity(rows, jobs, refs).select("seq", "found_id")


_SIGHTINGS = duck(SIGHTINGS)


@query(
    "best_link",
    f"""WITH s AS ({_SIGHTINGS}), j AS (SELECT min(seq) AS job_id, user_id FROM s GROUP BY user_id),
 own AS (SELECT j.job_id, s.user_id, s.source, s.source_url, s.canonical_url FROM j JOIN s ON s.seq = j.job_id),
 c AS (SELECT job_id, source, source_url, -1 AS place FROM own
  UNION ALL SELECT j.job_id, s.source, s.source_url, s.seq FROM s JOIN j ON j.user_id = s.user_id),
 best AS (SELECT job_id, arg_min(source_url, ({q.tier('source')}, place)) AS url FROM c WHERE source_url IS NOT NULL GROUP BY job_id)
SELECT own.job_id, coalesce(best.url, own.canonical_url) AS application_url FROM own LEFT JOIN best ON best.job_id = own.job_id""",
)
def best_link(t: Tables) -> DataFrame:
    """One record per user, every sighting a reference."""
    seen = t.sightings
    first = F.min_by(F.struct("source", "source_url", "canonical_url"), "seq")
    jobs = seen.groupBy("user_id").agg(F.min("seq").alias("job_id"), first.alias("f")).select("user_id", "job_id", "f.*")
    refs = seen.select("user_id", "source", "source_url", F.col("seq").alias("ref_id")).join(
        jobs.select("user_id", "job_id"), "user_id"
    )
    return best_links(jobs, refs)


@query(
    "priority_lookup",
    f"""WITH e AS ({duck(ENTITIES)}) SELECT t.job_id, coalesce(e.priority, 'C') AS priority
FROM ({duck(TRACKING)}) t LEFT JOIN e ON e.name = t.company_name""",
)
def priority_lookup(t: Tables) -> DataFrame:
    return with_priority(t.tracking, t.entities).select("job_id", "priority")


@query(
    "change_detect",
    f"""WITH {q.NORM}, base AS (SELECT content_hash, arg_min(struct_pack(p := posted_date, d := description, s := skills), seq) AS first, min(seq) AS job_id
 FROM norm GROUP BY content_hash)
SELECT n.seq, n.posted_date IS DISTINCT FROM first.p OR n.description IS DISTINCT FROM first.d OR n.skills IS DISTINCT FROM first.s AS data_changed
FROM norm n JOIN base USING (content_hash)""",
)
def change_detect(t: Tables) -> DataFrame:
    """Each posting against the first one with its identity."""
    rows = stage(normalize_postings(t.postings).select("seq", "content_hash", "content_print"), "prints")
    first = rows.groupBy("content_hash").agg(F.min_by("content_print", "seq").alias("first_print"))
    return rows.join(first, "content_hash").select(
        "seq", changed([F.col("content_print")], [F.col("first_print")]).alias("data_changed")
    )


_RUN_FLAGS = "min(seq) OVER (PARTITION BY content_hash) = seq"


@query(
    "run_counters",
    f"""WITH {q.SCORED}, d AS (SELECT seq, content_hash, {_RUN_FLAGS} AS is_new, reject_reason IS NULL AS accepted, match_score,
 posted_date IS DISTINCT FROM arg_min(struct_pack(x := posted_date), seq) OVER (PARTITION BY content_hash).x AS data_changed FROM scored)
SELECT count(*) AS jobs_found, count(*) FILTER (is_new) AS new_jobs, count(*) FILTER (NOT is_new AND data_changed) AS updated_jobs,
 count(*) FILTER (NOT is_new) AS duplicates, count(*) FILTER (is_new AND NOT accepted) AS filtered_out,
 count(*) FILTER (is_new AND accepted AND match_score < 50) AS below_threshold,
 count(*) FILTER (is_new AND accepted AND match_score >= 75) AS high_match FROM d""",
)
def counters(t: Tables) -> DataFrame:
    """Counters with identity taken from the content hash alone."""
    rows = stage(
        with_score(judged(t, CONFIG), CONFIG, only_accepted=True).select(
            "seq", "content_hash", "accepted", "match_score", "posted_date"
        ),
        "judged",
    )
    first = rows.groupBy("content_hash").agg(
        F.min("seq").alias("first_seq"), F.min_by("posted_date", "seq").alias("first_posted")
    )
    is_new = F.col("seq") == F.col("first_seq")
    decisions = rows.join(first, "content_hash").select(
        is_new.alias("is_new"),
        is_new.alias("evaluated"),
        F.lit(False).alias("promoted"),
        changed([F.col("posted_date")], [F.col("first_posted")]).alias("data_changed"),
        "accepted",
        "match_score",
    )
    return run_counters(decisions, CONFIG.high_match_score, CONFIG.minimum_match_score)


_WANTED = "SELECT CAST(n_nationkey AS BIGINT) AS position, n_name AS location FROM {nation} WHERE n_nationkey % 2 = 0"
_ALIASES = """
SELECT upper(n.n_name) AS location, CASE WHEN s.s_suppkey % 3 = 0 THEN 'Everywhere' WHEN s.s_suppkey % 5 = 0 THEN n.n_name ELSE s.s_name END AS alias,
 CAST(s.s_suppkey AS BIGINT) AS place FROM {nation} n JOIN {supplier} s ON s.s_nationkey = n.n_nationkey
"""


@query(
    "location_variants",
    f"""WITH w AS ({duck(_WANTED)}), a AS ({duck(_ALIASES)}), v AS (
 SELECT position, -1 AS place, lower(location) AS name FROM w UNION ALL
 SELECT w.position, a.place, lower(a.alias) FROM w JOIN a ON lower(a.location) = lower(w.location))
SELECT position, CAST(place AS BIGINT) AS place, name FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY position, place) = 1""",
)
def location_variants(t: Tables) -> DataFrame:
    return pred.location_variants(t.sql(_WANTED), t.sql(_ALIASES))
