"""Row predicates, orders, exports and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators import predicates as pred
from rolecall.operators.firsts import last_finished_run
from rolecall.operators.match import with_priority
from rolecall.operators.rank import latest_errors, listing_order, newest_since, numbered, rank_order, ranked, top_scored
from rolecall.operators.score import with_score
from rolecall.plans import reports
from rolecall.plans.exports import export_rows, ranked_views, read_in_order, write_in_order
from rolecall.schemas import COUNTER_NAMES, DISCOVERY
from rolecall.session import shared_folder
from rolecall.workload import sqltext as q
from rolecall.workload.catalog import query
from rolecall.workload.matching import judged
from rolecall.workload.tables import CONFIG, ENTITIES, ERRORS, TRACKING, Tables, duck
from rolecall.workload.tracking import AT, moment

_NOW = f"TIMESTAMP '{AT}'"
_PRIORITY = "CASE coalesce(e.priority, 'C') WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END"
_ORDER = f"coalesce(t.match_score, -1) DESC, {_PRIORITY}, coalesce(t.posted_at, TIMESTAMP '1970-01-01 00:00:00') DESC, t.company_name, t.title, t.job_id"
_WITH = f"WITH t AS ({duck(TRACKING)}), e AS ({duck(ENTITIES)})"


@query(
    "row_predicates",
    f"SELECT job_id, status, match_score FROM ({duck(TRACKING)}) WHERE is_active AND status = 'NEW' AND match_score >= 50",
)
def row_predicates(t: Tables) -> DataFrame:
    return pred.listed(t.tracking, True, "NEW", 50).select("job_id", "status", "match_score")


@query(
    "score_thresholds",
    f"""SELECT job_id, match_score, match_score >= 75 AS high FROM ({duck(TRACKING)}) WHERE match_score >= 50""",
)
def score_thresholds(t: Tables) -> DataFrame:
    return pred.relevant(t.tracking, CONFIG).select("job_id", "match_score", pred.is_high_match(CONFIG).alias("high"))


@query("rank_all", f"{_WITH} SELECT t.job_id, t.match_score, coalesce(e.priority, 'C') AS priority FROM t LEFT JOIN e ON e.name = t.company_name ORDER BY {_ORDER}")
def rank_all(t: Tables) -> DataFrame:
    return ranked(with_priority(t.tracking, t.entities)).select("job_id", "match_score", "priority")


@query(
    "rank_top10",
    f"{_WITH} SELECT t.job_id, t.match_score, coalesce(e.priority, 'C') AS priority FROM t LEFT JOIN e ON e.name = t.company_name WHERE t.match_score IS NOT NULL ORDER BY {_ORDER} LIMIT 10",
)
def rank_top10(t: Tables) -> DataFrame:
    return top_scored(with_priority(t.tracking, t.entities)).select("job_id", "match_score", "priority")


@query(
    "posting_top10",
    f"""WITH {q.SCORED} SELECT s.seq AS job_id, s.match_score, s.company_name, s.title FROM scored s
 LEFT JOIN entities e ON e.name = s.company_name WHERE s.reject_reason IS NULL ORDER BY s.match_score DESC,
 CASE coalesce(e.priority, 'C') WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END,
 coalesce(TRY_CAST(s.posted_date AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') DESC, s.company_name, s.title, s.seq LIMIT 10""",
)
def posting_top10(t: Tables) -> DataFrame:
    """From raw postings to the ten best: normalise, match, filter, score, rank."""
    scored = with_score(judged(t, CONFIG), CONFIG, only_accepted=True)
    shown = scored.select(F.col("seq").alias("job_id"), "company_name", "title", "match_score", "posted_at")
    return top_scored(with_priority(shown, t.entities)).select("job_id", "match_score", "company_name", "title")


@query("listing", f"SELECT job_id, match_score, company_name, title FROM ({duck(TRACKING)}) WHERE is_active ORDER BY match_score DESC NULLS LAST, company_name, title")
def listing(t: Tables) -> DataFrame:
    return pred.listed(t.tracking).orderBy(*listing_order()).select("job_id", "match_score", "company_name", "title")


@query(
    "newest",
    f"""SELECT job_id, first_seen FROM ({duck(TRACKING)}) WHERE first_seen > {_NOW} - INTERVAL 365 DAY
 ORDER BY first_seen DESC, match_score DESC NULLS LAST, company_name, title, job_id LIMIT 100""",
)
def newest(t: Tables) -> DataFrame:
    return newest_since(t.tracking, moment(AT) - F.expr("INTERVAL 365 DAYS")).select("job_id", "first_seen")


@query("latest_errors", f"SELECT error_id, source, error_type FROM ({duck(ERRORS)}) ORDER BY error_id DESC LIMIT 20")
def newest_errors(t: Tables) -> DataFrame:
    return latest_errors(t.errors).select("error_id", "source", "error_type")


@query(
    "entity_listing",
    f"SELECT name, domain, careers_url, priority, enabled, ats FROM ({duck(ENTITIES)}) WHERE enabled ORDER BY priority, name",
)
def entity_listing(t: Tables) -> DataFrame:
    return reports.entity_listing(t.entities, enabled_only=True)




def _runs(t: Tables) -> DataFrame:
    """One finished or running run per order, with counters from its amounts."""
    amount = F.floor("o_totalprice").cast("long")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("status"),
        F.struct(*[(amount + i).alias(n) for i, n in enumerate(COUNTER_NAMES)]).alias("counters"),
    )


_LAST = "(SELECT * FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey DESC LIMIT 1)"


@query("last_run", f"SELECT o_orderkey AS run_id, o_orderdate AS started_at, 'COMPLETED' AS status FROM {_LAST}")
def last_run(t: Tables) -> DataFrame:
    return last_finished_run(_runs(t)).select("run_id", "started_at", "status")


@query(
    "run_report",
    "SELECT m.metric, CAST(floor(o_totalprice) AS BIGINT) + m.i AS value FROM " + _LAST + " CROSS JOIN (VALUES "
    + ", ".join(f"('{n}', {i})" for i, n in enumerate(COUNTER_NAMES)) + ") m(metric, i)",
)
def run_report(t: Tables) -> DataFrame:
    return reports.run_report(_runs(t))


@query(
    "status_report",
    f"""{_WITH}, m AS (SELECT * FROM (SELECT count(*) AS jobs_total, count(*) FILTER (is_active) AS jobs_active,
  count(*) FILTER (is_active AND match_score IS NOT NULL) AS jobs_scored, count(*) FILTER (first_seen > {_NOW} - INTERVAL 1 DAY) AS jobs_new_24h,
  count(*) FILTER (first_seen > {_NOW} - INTERVAL 7 DAY) AS jobs_new_7d FROM t), (SELECT count(*) AS job_source_refs FROM lineitem),
  (SELECT count(*) AS companies, count(*) FILTER (enabled) AS companies_enabled FROM e), (SELECT count(DISTINCT source) AS sources FROM t), (SELECT count(*) AS errors FROM events))
SELECT metric, value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'status:' || status, count(*) FROM t GROUP BY status""",
)
def status_report(t: Tables) -> DataFrame:
    sources = t.tracking.select("source").distinct()
    return reports.status_report(t.tracking, t.lineitem, t.entities, sources, t.errors, moment(AT))


@query(
    "new_report",
    f"""{_WITH}, s AS (SELECT o_orderdate AS since FROM {_LAST}), n AS (SELECT count(*) FILTER (first_seen > since) AS since_last_run,
 count(*) FILTER (first_seen > {_NOW} - INTERVAL 1 DAY) AS last_24h, count(*) FILTER (first_seen > {_NOW} - INTERVAL 7 DAY) AS last_7d FROM t CROSS JOIN s)
SELECT metric, value FROM (UNPIVOT n ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def new_report(t: Tables) -> DataFrame:
    since = reports.since_moment(_runs(t), moment(AT))
    return reports.new_report(t.tracking.crossJoin(since), F.col("since"), moment(AT))


@query(
    "error_report",
    f"SELECT error_id, source, company, error_type, message[1:60] AS message, occurred_at FROM ({duck(ERRORS)}) ORDER BY error_id DESC LIMIT 20",
)
def error_report(t: Tables) -> DataFrame:
    return reports.error_report(t.errors).select(
        "error_id", "source", "company", "error_type", "message", "occurred_at"
    )


_EXPORT = f"""WITH {q.SCORED} SELECT s.seq, s.company_name AS "Company", coalesce(e.priority, '') AS "Priority", s.title AS "Job Title",
 coalesce(s.location, 'Not listed') AS "Location", CASE s.remote_status WHEN 'remote' THEN 'Yes (remote)' WHEN 'hybrid' THEN 'Hybrid' WHEN 'onsite' THEN 'No (onsite)' ELSE 'Unknown' END AS "Remote",
 s.experience_text AS "Experience", CASE WHEN s.reject_reason IS NULL THEN CAST(s.match_score AS VARCHAR) ELSE '' END AS "Match Score",
 CASE WHEN s.reject_reason IS NULL THEN array_to_string(list_filter([nullif(replace(s.reasons, ' & ', '; '), ''), CASE WHEN s.warnings <> '' THEN 'WARNING: ' || replace(s.warnings, ' & ', '; WARNING: ') END], lambda x: x IS NOT NULL), '; ') ELSE '' END AS "Match Reasons",
 coalesce(s.posted_date, 'Not listed') AS "Posted Date", s.source AS "Source", '' AS "ATS", s.canonical_url AS "Canonical URL", s.source_url AS "Application URL",
 'NEW' || CASE WHEN s.source LIKE 'fixture%' THEN ' [FIXTURE]' ELSE '' END AS "Status"
FROM scored s LEFT JOIN entities e ON e.name = s.company_name"""


@query("export_rows", _EXPORT)
def exported(t: Tables) -> DataFrame:
    """The display row of every posting."""
    scored = with_score(judged(t, CONFIG), CONFIG, only_accepted=True)
    shown = with_priority(scored, t.entities, default="").withColumns(
        {"application_url": F.col("source_url"), "first_seen": F.col("seq"), "status": F.lit("NEW")}
    )
    return export_rows(shown).withColumnRenamed("First Seen", "seq")


# Stored content beside the tracking rows, references from order lines, and every view's shown text.
_SHOWN_ROW = "concat_ws('|', t.company_name, coalesce(e.priority, ''), t.title, 'Pune', 'Yes (remote)', '1-2 yrs', coalesce(CAST(t.match_score AS VARCHAR), ''), t.title, 'Not listed', strftime(t.first_seen, '%Y-%m-%d %H:%M:%S'), t.source, '', t.canonical_url, coalesce(b.url, t.canonical_url), t.status)"


@query(
    "export_views",
    f"""{_WITH}, links AS (SELECT job_id, {q.tier('source')} AS tier, -1 AS place, source_url AS url FROM t WHERE is_active AND source_url IS NOT NULL
 UNION ALL SELECT l_orderkey, 2, l_linenumber, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT job_id, arg_min(url, (tier, place)) AS url FROM links GROUP BY job_id),
r AS (SELECT t.status, t.match_score, row_number() OVER (ORDER BY {_ORDER}) AS place, {_SHOWN_ROW} AS shown
 FROM t LEFT JOIN e ON e.name = t.company_name LEFT JOIN b ON b.job_id = t.job_id WHERE t.is_active)
SELECT 'new_jobs' AS view, place, shown FROM r WHERE status = 'NEW' UNION ALL SELECT 'high_match', place, shown FROM r WHERE match_score >= 75
UNION ALL SELECT 'all_active', place, shown FROM r
UNION ALL SELECT 'companies', row_number() OVER (ORDER BY priority, name), concat_ws('|', name, domain, coalesce(careers_url, ''), priority, CAST(enabled AS VARCHAR), '') FROM e
UNION ALL SELECT 'sources', row_number() OVER (ORDER BY source), source FROM (SELECT DISTINCT source FROM t)
UNION ALL SELECT 'errors', row_number() OVER (ORDER BY error_id DESC), concat_ws('|', CAST(error_id AS VARCHAR), source, coalesce(company, ''), error_type, message, strftime(occurred_at, '%Y-%m-%d %H:%M:%S')) FROM ({duck(ERRORS)})
UNION ALL SELECT 'discovery', row_number() OVER (ORDER BY c_name), c_name || '||||||' FROM customer""",
)
def view_rows(t: Tables) -> DataFrame:
    """Every row of the seven views: its place and all its shown columns."""
    tracking = t.tracking.withColumns(
        {"match_reasons": F.array("title"), "match_warnings": F.array().cast("array<string>")}
    )
    content = t.tracking.select(
        "job_id", "company_name", "title", "posted_at", F.lit("Pune").alias("location"), F.lit("remote").alias("remote_status"),
        F.lit(1).alias("experience_min"), F.lit(2).alias("experience_max"), F.lit(None).cast("string").alias("posted_date"),
        F.lit(None).cast("string").alias("ats"), F.lit(False).alias("is_fixture"),
        F.lit("").alias("content_hash"), F.lit(None).cast("timestamp").alias("first_seen"),
    )
    refs = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("at")).select(
        F.col("l_orderkey").alias("job_id"), F.lit("lever").alias("source"), F.col("at").cast("date").cast("string").alias("source_url"),
        F.col("l_linenumber").cast("long").alias("ref_id"),
    )
    discovery = t.spark.createDataFrame([], DISCOVERY).unionByName(
        t.customer.select(F.col("c_name").alias("company_name")), allowMissingColumns=True
    )
    views = ranked_views(
        content, tracking.drop("company_name", "title", "posted_at"), refs, t.entities, t.tracking.select("source").distinct(),
        t.errors, discovery, CONFIG,
    )
    order = {
        "companies": ["priority", "name"], "sources": ["source"], "errors": [F.col("error_id").desc()], "discovery": ["company_name"],
    }
    out = None
    for name, view in views.items():
        columns = [c for c in view.columns if c != "rank"]
        if name in order:
            view = numbered(view, [F.col(c) if isinstance(c, str) else c for c in order[name]])
        text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if view.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("string") for c in columns]
        shown = F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in text])
        part = view.select(F.lit(name).alias("view"), F.col("rank").alias("place"), shown.alias("shown"))
        out = part if out is None else out.unionByName(part)
    return out


@query("rank_number", f"{_WITH} SELECT t.job_id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM t LEFT JOIN e ON e.name = t.company_name")
def rank_number(t: Tables) -> DataFrame:
    """The place of every record in the ranking."""
    return numbered(with_priority(t.tracking, t.entities), rank_order()).select("job_id", "rank")


@query(
    "ordered_export",
    f"{_WITH} SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, t.job_id, t.company_name, t.title, t.match_score FROM t LEFT JOIN e ON e.name = t.company_name",
)
def ordered_export(t: Tables) -> DataFrame:
    """The ranking written as ordered CSV files and read back by their manifest."""
    rows = with_priority(t.tracking, t.entities)
    shown = rows.select("job_id", "company_name", "title", "match_score", "priority", "posted_at")
    folder = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    write_in_order(shown, rank_order(), folder)
    return read_in_order(t.spark, folder, shown.schema).select("rank", "job_id", "company_name", "title", "match_score")


@query(
    "newest_more",
    f"SELECT greatest(count(*) FILTER (first_seen > {_NOW} - INTERVAL 365 DAY) - 100, 0) AS n_more FROM ({duck(TRACKING)})",
)
def newest_more(t: Tables) -> DataFrame:
    """How many new records a report of a hundred leaves out."""
    return reports.new_rows(t.tracking, moment(AT) - F.expr("INTERVAL 365 DAYS"))[1]


_SOURCE_ROWS = """
SELECT source, min(source_type) AS source_type, bool_or(value > 50) AS enabled, max(status) AS status, max(ts) AS last_run_at,
 CAST(NULL AS TIMESTAMP) AS last_success_at, CAST(NULL AS STRING) AS last_error, CAST(floor(sum(value)) AS BIGINT) AS jobs_found
FROM (SELECT concat('src', CAST(user_id % 7 AS STRING)) AS source, event_type AS source_type, CASE WHEN user_id % 2 = 0 THEN 'OK' ELSE 'FAILED' END AS status, value, ts FROM {events}) x
GROUP BY source
"""


@query(
    "status_lines",
    f"""SELECT source AS line, status || CASE WHEN enabled THEN '' ELSE ' (off in config)' END AS status, jobs_found, last_run_at AS at FROM ({duck(_SOURCE_ROWS)})
UNION ALL SELECT 'run #' || o_orderkey, 'COMPLETED', CAST(floor(o_totalprice) AS BIGINT) + {COUNTER_NAMES.index("jobs_found")}, o_orderdate FROM {_LAST}""",
)
def status_lines(t: Tables) -> DataFrame:
    return reports.status_lines(t.sql(_SOURCE_ROWS), _runs(t))


@query("source_listing", f"SELECT source, source_type, enabled, status, jobs_found FROM ({duck(_SOURCE_ROWS)}) ORDER BY source")
def source_listing(t: Tables) -> DataFrame:
    return reports.source_listing(t.sql(_SOURCE_ROWS)).select("source", "source_type", "enabled", "status", "jobs_found")


@query("discovery_listing", "SELECT c_name AS company_name, c_mktsegment AS ats FROM customer ORDER BY 1")
def discovery_rows(t: Tables) -> DataFrame:
    found = t.customer.select(F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("ats"))
    return reports.discovery_listing(found)
