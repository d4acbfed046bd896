"""Sources, scopes and fetch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import clean_text
from rolecall.sources.feeds import (
    broken_rows,
    combine,
    entity_rows,
    explode_entries,
    narrow,
    quarantine_split,
    select_entities,
    to_raw,
)
from rolecall.sources.registry import choose_sources, entity_results, mark_not_available
from rolecall.sources.triage import (
    NO_PAGE_ACTION,
    NO_PAGE_REASON,
    PAGE_REASON,
    review_queue,
    triage,
)
from rolecall.workload import sqltext as q
from rolecall.workload.catalog import query
from rolecall.workload.tables import ENTITIES, POSTINGS, RESPONSES, Tables, duck


@query(
    "scan_explode",
    f"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, {q.clean('line')} AS title, coalesce(nullif(lang, 'en'), 'fixture') AS source FROM
 (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
)
def scan_explode(t: Tables) -> DataFrame:
    """Documents as arrays of entries, one row per entry in its order."""
    lines = F.transform(
        F.split("text", "\n"), lambda x: F.struct(F.nullif(F.col("lang"), F.lit("en")).alias("source"), x.alias("title"))
    )
    rows = explode_entries(t.documents, lines, ("doc_id",)).withColumn("seq", F.col("pos").cast("long"))
    return rows.select(
        "doc_id", "pos", clean_text(F.col("title")).alias("title"), F.coalesce("source", F.lit("fixture")).alias("source")
    )


_TARGETS = """
SELECT CASE WHEN c_custkey % 40 = 0 THEN '  ' ELSE concat(' ', c_name, ' ') END AS company_name,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('c', CAST(c_custkey AS STRING), '.example') END AS company_domain,
 CASE WHEN c_custkey % 4 = 0 THEN concat('https://c', CAST(c_custkey AS STRING), '.example/jobs') ELSE NULL END AS careers_url,
 CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'c' END AS priority,
 CASE c_custkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN NULL ELSE ' Y ' END AS enabled
FROM {customer}
"""


@query(
    "entity_list",
    f"""SELECT nullif(trim(company_name), '') AS name, nullif(trim(company_domain), '') AS domain, nullif(trim(careers_url), '') AS careers_url,
 upper(coalesce(nullif(trim(priority), ''), 'B')) AS priority, coalesce(lower(trim(enabled)) IN ('1', 'true', 'yes', 'y'), FALSE) AS enabled,
 trim(company_name) = '' AS rejected FROM ({duck(_TARGETS)})""",
)
def entity_list(t: Tables) -> DataFrame:
    good, rejected = entity_rows(t.sql(_TARGETS))
    kept = ["name", "domain", "careers_url", "priority", "enabled"]
    return good.select(*kept, F.lit(False).alias("rejected")).unionByName(
        rejected.select(*kept, F.lit(True).alias("rejected"))
    )


@query(
    "source_pushdown",
    f"""SELECT seq, company_name FROM ({duck(POSTINGS)}) WHERE contains(lower(company_name), 'supplier#00000000') ORDER BY seq LIMIT 100""",
)
def source_pushdown(t: Tables) -> DataFrame:
    return narrow(t.postings, "Supplier#00000000", 100).select("seq", "company_name")


@query(
    "source_union",
    """SELECT o_orderkey AS seq, 'orders' AS source, CAST(o_custkey AS VARCHAR) AS source_job_id, o_orderpriority AS title,
 CAST(NULL AS VARCHAR) AS source_url FROM orders
UNION ALL SELECT page_id + 1048576 * (1 + (SELECT max(o_orderkey) // 1048576 FROM orders)), 'pages', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), url FROM pages
UNION ALL SELECT event_id + 1048576 * (2 + (SELECT max(o_orderkey) // 1048576 FROM orders) + (SELECT max(page_id) // 1048576 FROM pages)), event_type, CAST(user_id AS VARCHAR), props, CAST(NULL AS VARCHAR) FROM events""",
)
def source_union(t: Tables) -> DataFrame:
    """Three tables of different shape in the one raw layout."""
    orders = t.orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("source_job_id"),
        F.col("o_orderpriority").alias("title"),
    )
    pages = t.pages.select(F.col("page_id").alias("seq"), "url")
    events = t.events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("source_job_id"), F.col("props").alias("title"),
    )
    parts = [to_raw(orders, "orders"), to_raw(pages, "pages"), to_raw(events, "events")]
    return combine(parts).select("seq", "source", "source_job_id", "title", "source_url")


@query(
    "source_selection",
    """WITH asked AS (SELECT DISTINCT event_type AS source FROM events UNION SELECT DISTINCT source FROM documents),
 installed AS (SELECT DISTINCT source FROM documents WHERE lang = 'de')
SELECT source, 'NOT_AVAILABLE' AS status, CAST(0 AS BIGINT) AS n_jobs FROM asked ANTI JOIN installed USING (source)""",
)
def source_selection(t: Tables) -> DataFrame:
    """Asked-for sources without a reader become NOT_AVAILABLE results."""
    asked = t.events.select(F.col("event_type").alias("source")).union(t.documents.select("source")).distinct()
    installed = t.documents.where(F.col("lang") == "de").select("source").distinct()
    return mark_not_available(asked.join(installed, "source", "left_anti")).select("source", "status", "n_jobs")


# Configured sources: one per user, switched on for most; readers exist for some.
_CONFIGURED = "SELECT concat('src', CAST(user_id AS STRING)) AS source, max(value) > 60 AS enabled, min(user_id) AS num FROM {events} GROUP BY user_id"


def _choice(listed: str, mode: str) -> str:
    fits = "TRUE" if mode == "both" else f"mode = '{mode}'"
    return f"""SELECT c.source, CASE WHEN mode IS NULL THEN 'NOT_AVAILABLE' WHEN {fits} THEN 'RUN' ELSE 'OTHER_MODE' END AS outcome
FROM (SELECT *, CASE WHEN num % 5 = 0 THEN NULL WHEN num % 3 = 0 THEN 'company' ELSE 'board' END AS mode FROM ({duck(_CONFIGURED)})) c WHERE {listed}"""


@query(
    "source_choice",
    f"""SELECT 'enabled' AS asked, * FROM ({_choice('enabled', 'both')}) UNION ALL SELECT 'listed', * FROM ({_choice('num % 4 = 1', 'company')})""",
)
def source_choice(t: Tables) -> DataFrame:
    """Sources that are switched on, and exactly the listed ones of one mode."""
    configured = t.sql(_CONFIGURED)
    installed = configured.where("num % 5 <> 0").select("source", F.when(F.col("num") % 3 == 0, "company").otherwise("board").alias("mode"))
    unknown = t.spark.createDataFrame([("nobody",)], "source string")
    listed = configured.where("num % 4 = 1").select("source").union(unknown)
    on = choose_sources(configured, installed).withColumn("asked", F.lit("enabled"))
    return on.unionByName(choose_sources(configured, installed, listed, "company").withColumn("asked", F.lit("listed")))


@query(
    "entity_results",
    f"""WITH e AS (SELECT DISTINCT name FROM ({duck(ENTITIES)}) WHERE enabled),
 r AS (SELECT coalesce(nullif(company_hint, ''), company_name) AS name, count(*) AS n FROM ({duck(POSTINGS)}) GROUP BY 1)
SELECT e.name AS company, coalesce(r.n, 0) AS n_jobs, 'OK' AS status FROM e LEFT JOIN r ON r.name = e.name
UNION ALL SELECT NULL, sum(n)::BIGINT, 'OK' FROM r WHERE name NOT IN (SELECT name FROM e) HAVING sum(n) > 0""",
)
def results_by_entity(t: Tables) -> DataFrame:
    """One fetch result for each entity of a source that returned the postings."""
    rows = t.postings.select("company_hint", "company_name")
    return entity_results(rows, t.entities.where("enabled"), "feed").select("company", "n_jobs", "status")


@query(
    "entity_selection",
    f"""SELECT name, priority FROM ({duck(ENTITIES)}) WHERE enabled AND contains(lower(name), '#00000000') ORDER BY priority, name LIMIT 7""",
)
def entity_selection(t: Tables) -> DataFrame:
    return select_entities(t.entities, "#00000000", 7).select("name", "priority")


@query(
    "manual_review_queue",
    f"""SELECT entity_id AS seq, 'generic' AS source, 'MANUAL_REVIEW' AS status, name AS company, careers_url AS url,
 CASE WHEN careers_url IS NULL THEN '{NO_PAGE_REASON.replace("'", "''")}' ELSE '{PAGE_REASON}' END AS reason,
 CASE WHEN careers_url IS NULL THEN '{NO_PAGE_ACTION.replace("'", "''")}' ELSE 'Open ' || careers_url || ' in a browser and review it by hand.' END AS action,
 CAST(0 AS BIGINT) AS n_jobs FROM ({duck(ENTITIES)})""",
)
def manual_review_queue(t: Tables) -> DataFrame:
    return review_queue(t.entities, seq=F.col("entity_id"))


@query(
    "response_triage",
    f"""WITH r AS ({duck(RESPONSES)}), j AS (SELECT *, lower(body) AS head FROM r)
SELECT seq, CASE WHEN status = 200 THEN 'OK'
 WHEN status IN (401, 403, 429, 503) OR (status >= 400 AND contains(head, 'verify you are human')) THEN 'MANUAL_REVIEW'
 WHEN status = 404 THEN 'FAILED' WHEN status BETWEEN 500 AND 599 THEN CASE WHEN attempt < 2 THEN 'RETRY' ELSE 'FAILED' END ELSE 'FAILED' END AS outcome,
 CASE WHEN status = 200 THEN NULL
 WHEN status IN (401, 403, 429, 503) OR (status >= 400 AND contains(head, 'verify you are human'))
  THEN 'HTTP ' || CAST(status AS VARCHAR) || ' - access blocked or rate limited; not retried'
 WHEN status = 404 THEN 'HTTP 404 - page not found'
 WHEN status BETWEEN 500 AND 599 THEN 'HTTP ' || CAST(status AS VARCHAR) || ' - server error' ||
  CASE WHEN attempt < 2 THEN '' ELSE ' after ' || CAST(attempt + 1 AS VARCHAR) || ' attempts' END
 ELSE 'HTTP ' || CAST(status AS VARCHAR) || ' - unexpected response' END AS outcome_reason FROM j""",
)
def response_triage(t: Tables) -> DataFrame:
    return triage(t.responses).select("seq", "outcome", "outcome_reason")


# Payload lines of a feed, one per event; every fifth is cut off and every seventh is no object.
_LINES = """
SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN concat('{{"company_name": "Customer ', CAST(user_id AS STRING), '", "title": "tr')
 WHEN event_id % 7 = 0 THEN concat('no record ', CAST(event_id AS STRING))
 ELSE concat('{{"source": "', event_type, '", "company_name": "Customer ', CAST(user_id AS STRING), '", "title": "', event_type, ' ', CAST(event_id AS STRING), '"}}') END AS line
FROM {events}
"""


@query(
    "quarantine_split",
    f"""SELECT seq, CASE WHEN bad THEN NULL ELSE event_type END AS source, CASE WHEN bad THEN NULL ELSE 'Customer ' || user_id END AS company_name,
 CASE WHEN bad THEN NULL ELSE event_type || ' ' || seq END AS title, CASE WHEN bad THEN 'unreadable record: ' || line END AS message
FROM (SELECT l.*, e.event_type, e.user_id, l.seq % 5 = 0 OR l.seq % 7 = 0 AS bad FROM ({duck(_LINES)}) l JOIN events e ON e.event_id = l.seq)""",
)
def broken_lines(t: Tables) -> DataFrame:
    """Good records of a feed, and an error row for each broken line."""
    good, broken = quarantine_split(t.sql(_LINES), "line")
    rows = good.select("seq", "source", "company_name", "title", F.lit(None).cast("string").alias("message"))
    message = broken_rows(broken, "feed").select("message", "seq")
    return rows.unionByName(message, allowMissingColumns=True)
