"""Firsts and latests, upserts, prunes, ageing and identity resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators import aggregates as agg
from rolecall.operators import upsert as up
from rolecall.operators.firsts import first_per, latest_review_rows, promoted_source
from rolecall.operators.identity import resolve_batch
from rolecall.operators.lifecycle import days, expire, latest_match, touch
from rolecall.operators.match import match_entities
from rolecall.operators.normalize import normalize_postings
from rolecall.plans.run import decide, judged_facts, next_refs, next_tracking
from rolecall.plans.state import StateStore
from rolecall.schemas import CONTENT, COUNTER_NAMES, REFS, SOURCES
from rolecall.schemas import TRACKING as TRACKING_LAYOUT
from rolecall.session import shared_folder, stage, stage_alone
from rolecall.workload import sqltext as q
from rolecall.workload.catalog import query
from rolecall.workload.tables import (
    AS_OF,
    CONFIG,
    ENTITIES,
    ERRORS,
    RESULTS,
    SIGHTINGS,
    TRACKING,
    Tables,
    duck,
)

_NOW = "TIMESTAMP '2001-08-02 00:00:00'"


def moment(text: str):
    return F.to_timestamp(F.lit(text))


AT = "2001-08-02 00:00:00"

# --- first and latest rows -------------------------------------------------------------


@query(
    "first_per_identity",
    f"""WITH {q.NORM} SELECT content_hash, min(seq) AS seq, arg_min(source, seq) AS source, arg_min(title, seq) AS title,
 arg_min(canonical_url, seq) AS canonical_url FROM norm GROUP BY content_hash""",
)
def first_per_identity(t: Tables) -> DataFrame:
    rows = normalize_postings(t.postings).select("content_hash", "seq", "source", "title", "canonical_url")
    return first_per(rows, ["content_hash"])


@query(
    "first_copy_of_text",
    """SELECT sha256(text) AS digest, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
FROM documents GROUP BY 1""",
)
def first_copy_of_text(t: Tables) -> DataFrame:
    rows = t.documents.select(F.sha2("text", 256).alias("digest"), "doc_id", "lang", "source")
    return first_per(rows, ["digest"], "doc_id")


@query(
    "promote_source",
    f"""WITH s AS ({duck(SIGHTINGS)}), k AS (SELECT *, ({q.tier('source')}) * 1000000000000 + seq AS place FROM s)
SELECT user_id, arg_min(source, place) AS source, arg_min(source_job_id, place) AS source_job_id,
 arg_min(struct_pack(u := source_url), place).u AS source_url, arg_min(canonical_url, place) AS canonical_url FROM k GROUP BY user_id""",
)
def promote_source(t: Tables) -> DataFrame:
    return promoted_source(t.sightings, "user_id")


@query(
    "evaluate_once",
    f"""WITH s AS ({duck(SIGHTINGS)}) SELECT CAST(ts AS DATE) AS run_day, record, min(seq) AS seq FROM s GROUP BY 1, 2""",
)
def evaluate_once(t: Tables) -> DataFrame:
    """The one row on which a record is judged in each (daily) run."""
    rows = t.sightings.select(F.to_date("ts").alias("run_day"), "record", "seq")
    return first_per(rows, ["run_day", "record"])


@query(
    "latest_review_row",
    f"""WITH e AS ({duck(ERRORS)}), k AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY error_id DESC) AS rn
 FROM e WHERE error_type = 'MANUAL_REVIEW')
SELECT error_id, source, company, error_type FROM k WHERE rn = 1
UNION ALL SELECT error_id, source, company, error_type FROM e WHERE error_type <> 'MANUAL_REVIEW'""",
)
def latest_review_row(t: Tables) -> DataFrame:
    return latest_review_rows(t.errors).select("error_id", "source", "company", "error_type")


@query(
    "match_write_back",
    f"""WITH {q.MATCHED} SELECT CAST(regexp_extract(source_url, '/p/([0-9]+)', 1) AS BIGINT) AS job_id,
 arg_max(target_match, seq) FILTER (target_match IS NOT NULL) AS target_match FROM matched GROUP BY 1""",
)
def match_write_back(t: Tables) -> DataFrame:
    """Latest entity match per posting page."""
    rows = match_entities(normalize_postings(t.postings), t.entities)
    page = F.regexp_extract("source_url", "/p/([0-9]+)", 1).cast("long")
    return latest_match(rows.select(page.alias("job_id"), "seq", "target_match"))


# --- counts ----------------------------------------------------------------------------


@query(
    "worst_status",
    f"""WITH r AS ({duck(RESULTS)}), c AS (SELECT *, CASE status WHEN 'OK' THEN 0 WHEN 'NOT_AVAILABLE' THEN 1 WHEN 'MANUAL_REVIEW' THEN 2 ELSE 3 END AS code FROM r),
 w AS (SELECT source, max(code) AS code, CAST(coalesce(sum(n_jobs) FILTER (status = 'OK'), 0) AS BIGINT) AS n_jobs,
  arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM c GROUP BY source)
SELECT source, ['OK', 'NOT_AVAILABLE', 'MANUAL_REVIEW', 'FAILED'][code + 1] AS status, n_jobs, CASE WHEN code >= 2 THEN reason END AS last_reason FROM w""",
)
def worst_status(t: Tables) -> DataFrame:
    return agg.source_outcomes(t.results)


@query(
    "fetch_counters",
    f"""WITH r AS ({duck(RESULTS)}) SELECT count(DISTINCT company) FILTER (source IN ('src0', 'src4')) AS companies_processed,
 count(DISTINCT company) FILTER (source IN ('src0', 'src4') AND status = 'FAILED') AS companies_failed,
 count(DISTINCT source) FILTER (status <> 'NOT_AVAILABLE') AS sources_processed, count(DISTINCT source) FILTER (status = 'NOT_AVAILABLE') AS sources_not_available,
 count(*) FILTER (status = 'MANUAL_REVIEW') AS manual_review, count(*) FILTER (status = 'FAILED') AS errors FROM r""",
)
def fetch_counters(t: Tables) -> DataFrame:
    return agg.fetch_counters(t.results, ["src0", "src4"])


@query("status_counts", f"SELECT status, count(*) AS n FROM ({duck(TRACKING)}) GROUP BY status")
def status_counts(t: Tables) -> DataFrame:
    return agg.status_counts(t.tracking)


@query(
    "state_totals",
    f"""WITH t AS ({duck(TRACKING)}), e AS ({duck(ENTITIES)}) SELECT * FROM
 (SELECT count(*) AS jobs_total, count(*) FILTER (is_active) AS jobs_active, count(*) FILTER (is_active AND match_score IS NOT NULL) AS jobs_scored,
  count(*) FILTER (first_seen > {_NOW} - INTERVAL 1 DAY) AS jobs_new_24h, count(*) FILTER (first_seen > {_NOW} - INTERVAL 7 DAY) AS jobs_new_7d FROM t),
 (SELECT count(*) AS job_source_refs FROM lineitem), (SELECT count(*) AS companies, count(*) FILTER (enabled) AS companies_enabled FROM e),
 (SELECT count(DISTINCT source) AS sources FROM t), (SELECT count(*) AS errors FROM events)""",
)
def state_totals(t: Tables) -> DataFrame:
    sources = t.tracking.select("source").distinct()
    return agg.state_totals(t.tracking, t.lineitem, t.entities, sources, t.errors, moment(AT))


@query(
    "new_since",
    f"""SELECT count(*) FILTER (first_seen > {_NOW} - INTERVAL 1 DAY) AS day, count(*) FILTER (first_seen > {_NOW} - INTERVAL 7 DAY) AS week,
 count(*) FILTER (first_seen > {_NOW} - INTERVAL 365 DAY) AS year FROM ({duck(TRACKING)})""",
)
def new_since(t: Tables) -> DataFrame:
    spans = {"day": 1, "week": 7, "year": 365}
    return agg.new_since(t.tracking, {name: moment(AT) - days(n) for name, n in spans.items()})


@query(
    "ref_stats",
    f"""WITH s AS ({duck(SIGHTINGS)}) SELECT record, source, source_job_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen,
 arg_max(source_url, seq) FILTER (source_url IS NOT NULL) AS source_url FROM s GROUP BY 1, 2, 3""",
)
def ref_stats(t: Tables) -> DataFrame:
    return agg.ref_stats(t.sightings, ["record", "source", "source_job_id"], "seq", "ts")


# --- upserts and prunes ----------------------------------------------------------------

_LISTED = """
SELECT concat('Supplier#', lpad(CAST(c_custkey AS STRING), 9, '0')) AS name, concat('new', CAST(c_custkey AS STRING), '.example.com') AS domain,
 CAST(NULL AS STRING) AS careers_url, CASE WHEN c_acctbal > 4000 THEN 'A' ELSE 'B' END AS priority, c_acctbal > 0 AS enabled,
 CASE WHEN c_custkey % 2 = 0 THEN 'lever' ELSE NULL END AS ats
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
"""
_STORED_ENTITIES = f"""
SELECT e.entity_id, e.name, e.domain, e.careers_url, e.priority, e.enabled, CASE WHEN e.entity_id % 3 = 0 THEN 'workday' ELSE NULL END AS ats,
 TIMESTAMP '2001-01-01 00:00:00' AS created_at, TIMESTAMP '2001-01-01 00:00:00' AS updated_at FROM ({ENTITIES}) e
"""


@query(
    "upsert_entities",
    f"""WITH o AS ({duck(_STORED_ENTITIES)}), n AS ({duck(_LISTED)})
SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NULL THEN o.domain ELSE n.domain END AS domain,
 CASE WHEN n.name IS NULL THEN o.careers_url ELSE n.careers_url END AS careers_url, coalesce(n.priority, o.priority) AS priority,
 coalesce(n.enabled, o.enabled) AS enabled, coalesce(n.ats, o.ats) AS ats, coalesce(o.created_at, {_NOW}) AS created_at,
 CASE WHEN n.name IS NULL THEN o.updated_at ELSE {_NOW} END AS updated_at FROM o FULL JOIN n ON o.name = n.name""",
)
def upsert_entities(t: Tables) -> DataFrame:
    merged = up.upsert_entities(t.sql(_STORED_ENTITIES), t.sql(_LISTED), moment(AT))
    return merged.drop("entity_id")


@query(
    "prune_split",
    """WITH keep AS (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'), used AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT c.c_custkey, CASE WHEN c.c_mktsegment <> 'MACHINERY' THEN NULL WHEN used.o_custkey IS NOT NULL THEN 'disable' ELSE 'delete' END AS prune_action
FROM customer c LEFT JOIN used ON used.o_custkey = c.c_custkey""",
)
def prune_split(t: Tables) -> DataFrame:
    """Customers off the list: switched off if an order refers to them, else removed."""
    entities = t.customer.select("c_custkey", "c_name")
    keep = t.customer.where(F.col("c_mktsegment") != "MACHINERY").select("c_name")
    used = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return up.prune_entities(entities, keep, used, name="c_name", key="c_custkey").select("c_custkey", "prune_action")


@query(
    "prune_reviews",
    f"""SELECT error_id FROM ({duck(ERRORS)}) WHERE error_type <> 'MANUAL_REVIEW' OR company IS NULL
 OR company IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def prune_reviews(t: Tables) -> DataFrame:
    keep = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_name").alias("name"))
    return up.prune_reviews(t.errors, keep).select("error_id")


_OLD_SOURCES = """
SELECT DISTINCT concat('src', CAST(user_id % 9 AS STRING)) AS source, 'other' AS source_type, TRUE AS enabled, 'OK' AS status,
 TIMESTAMP '2001-01-01 00:00:00' AS last_run_at, TIMESTAMP '2001-01-01 00:00:00' AS last_success_at, CAST(NULL AS STRING) AS last_error,
 CAST(100 AS BIGINT) AS jobs_found FROM {events} WHERE user_id % 9 > 1
"""


@query(
    "source_status",
    f"""WITH r AS ({duck(RESULTS)}), c AS (SELECT *, CASE status WHEN 'OK' THEN 0 WHEN 'NOT_AVAILABLE' THEN 1 WHEN 'MANUAL_REVIEW' THEN 2 ELSE 3 END AS code FROM r),
 w AS (SELECT source, max(code) AS code, CAST(coalesce(sum(n_jobs) FILTER (status = 'OK'), 0) AS BIGINT) AS n,
  arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM c GROUP BY source), o AS ({duck(_OLD_SOURCES)})
SELECT coalesce(o.source, w.source) AS source, CASE WHEN w.source IS NULL THEN o.status ELSE ['OK', 'NOT_AVAILABLE', 'MANUAL_REVIEW', 'FAILED'][w.code + 1] END AS status,
 CASE WHEN w.source IS NULL THEN o.last_run_at ELSE {_NOW} END AS last_run_at, CASE WHEN w.code = 0 THEN {_NOW} ELSE o.last_success_at END AS last_success_at,
 CASE WHEN w.code >= 2 THEN w.reason END AS last_error, coalesce(o.jobs_found, 0) + coalesce(w.n, 0) AS jobs_found
FROM o FULL JOIN w ON o.source = w.source""",
)
def source_status(t: Tables) -> DataFrame:
    old = t.sql(_OLD_SOURCES).to(SOURCES)
    merged = up.upsert_source_status(old, agg.source_outcomes(t.results), moment(AT))
    return merged.drop("source_type", "enabled")


_HALF = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "upsert_refs",
    f"""WITH s AS ({duck(SIGHTINGS)}) SELECT user_id AS job_id, source, source_job_id, min(seq) AS ref_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen,
 arg_max(source_url, seq) FILTER (source_url IS NOT NULL) AS source_url FROM s GROUP BY 1, 2, 3""",
)
def upsert_refs(t: Tables) -> DataFrame:
    """References after two batches must equal those of one pass over all sightings."""
    keys = ["job_id", "source", "source_job_id"]
    rows = t.sightings.withColumnRenamed("user_id", "job_id")
    cut = moment("2024-01-15 00:00:00")

    def seen(part: DataFrame) -> DataFrame:
        ids = part.groupBy(*keys).agg(F.min("seq").alias("ref_id"))
        return agg.ref_stats(part, keys, "seq", "ts").join(ids, keys)

    old = seen(rows.where(F.col("ts") < cut)).to(REFS)
    return up.upsert_refs(old, seen(rows.where(F.col("ts") >= cut)))


@query(
    "upsert_discovery",
    """WITH o AS (SELECT c_name AS company_name, 'lever' AS ats, c_mktsegment AS status FROM customer WHERE c_mktsegment <> 'BUILDING'),
 n AS (SELECT c_name AS company_name, CASE WHEN c_custkey % 2 = 0 THEN 'ashby' ELSE NULL END AS ats, 'FOUND' AS status FROM customer WHERE c_acctbal > 5000)
SELECT coalesce(n.company_name, o.company_name) AS company_name, CASE WHEN n.company_name IS NOT NULL THEN n.ats ELSE o.ats END AS ats,
 coalesce(n.status, o.status) AS status FROM o FULL JOIN n ON o.company_name = n.company_name""",
)
def upsert_discovery(t: Tables) -> DataFrame:
    rows = t.customer
    old = rows.where(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_name").alias("company_name"), F.lit("lever").alias("ats"), F.col("c_mktsegment").alias("status")
    )
    new = rows.where(F.col("c_acctbal") > 5000).select(
        F.col("c_name").alias("company_name"),
        F.when(F.col("c_custkey") % 2 == 0, "ashby").alias("ats"),
        F.lit("FOUND").alias("status"),
    )
    return up.upsert_discovery(old, new)


@query(
    "score_write_back",
    f"""SELECT t.job_id, CASE WHEN l.l_orderkey IS NOT NULL THEN CAST(floor(l.q) AS INTEGER) ELSE t.match_score END AS match_score
FROM ({duck(TRACKING)}) t LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = t.job_id""",
)
def score_write_back(t: Tables) -> DataFrame:
    """New scores replace old ones; a record without a new score keeps its own."""
    new = (
        t.lineitem.where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(F.floor(F.max("l_quantity")).cast("int").alias("match_score"))
    )
    old = t.tracking.select("job_id", "match_score")
    merged = up.upsert(old, new, ["job_id"], {"match_score": F.coalesce("new.match_score", "old.match_score")})
    return merged.join(old.select("job_id"), "job_id", "left_semi")


# --- ageing ----------------------------------------------------------------------------


@query(
    "touch",
    f"""WITH t AS ({duck(TRACKING)}), s AS (SELECT l_orderkey AS job_id, max(l_shipdate) AS at FROM lineitem GROUP BY 1)
SELECT t.job_id, CASE WHEN s.at IS NOT NULL AND t.status = 'NEW' AND s.at > t.first_seen + INTERVAL 7 DAY THEN 'SEEN' ELSE t.status END AS status,
 coalesce(s.at, t.last_seen) AS last_seen, t.is_active FROM t LEFT JOIN s ON s.job_id = t.job_id""",
)
def touched(t: Tables) -> DataFrame:
    seen = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").alias("seen_at"))
    return touch(t.tracking, seen, CONFIG.new_status_days).select("job_id", "status", "last_seen", "is_active")


@query(
    "expire",
    f"""SELECT job_id, CASE WHEN s THEN FALSE ELSE is_active END AS is_active, CASE WHEN s THEN 'INACTIVE' ELSE status END AS status
FROM (SELECT *, last_seen < {_NOW} - INTERVAL 14 DAY AND status NOT IN ('INACTIVE', 'EXPIRED') AS s FROM ({duck(TRACKING)}))""",
)
def expired(t: Tables) -> DataFrame:
    cutoff = moment(AT) - days(CONFIG.inactive_after_days)
    return expire(t.tracking, cutoff, moment(AT)).select("job_id", "is_active", "status")


# --- stored state ----------------------------------------------------------------------

_FOUND = "SELECT source, min(lang) AS source_type, CASE WHEN min(doc_id) % 2 = 0 THEN TRUE ELSE NULL END AS enabled FROM {documents} GROUP BY source"


@query(
    "upsert_sources",
    f"""WITH o AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN source ELSE event_type END AS source FROM events, (SELECT max(source) AS source FROM documents)),
 n AS ({duck(_FOUND)})
SELECT coalesce(n.source, o.source) AS source, coalesce(n.source_type, CASE WHEN o.source IS NOT NULL THEN 'board' END) AS source_type,
 coalesce(n.enabled, CASE WHEN o.source IS NOT NULL THEN FALSE END) AS enabled, CASE WHEN o.source IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS status,
 CASE WHEN o.source IS NULL THEN 0 ELSE 7 END AS jobs_found FROM o FULL JOIN n ON o.source = n.source""",
)
def upsert_sources(t: Tables) -> DataFrame:
    """Registered sources keep their history; listed ones are added or switched."""
    top = t.documents.agg(F.max("source").alias("top"))
    names = t.events.crossJoin(top).select(F.when(F.col("user_id") % 3 == 0, F.col("top")).otherwise(F.col("event_type")).alias("source"))
    old = names.distinct().select(
        "source", F.lit("board").alias("source_type"), F.lit(False).alias("enabled"), F.lit("OK").alias("status"), F.lit(7).cast("long").alias("jobs_found")
    )
    new = t.sql(_FOUND)
    return up.upsert_sources(t.spark.createDataFrame([], SOURCES).unionByName(old, allowMissingColumns=True), new).select(
        "source", "source_type", "enabled", "status", F.col("jobs_found").cast("int").alias("jobs_found")
    )


def _store(t: Tables) -> StateStore:
    return StateStore(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")


@query(
    "state_versions",
    f"""WITH t AS ({duck(TRACKING)}), s AS (SELECT l_orderkey AS job_id, max(l_shipdate) AS seen, min(l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT t.job_id, CASE WHEN p % 40 = 0 OR p % 40 = 1 THEN seen ELSE t.last_seen END AS last_seen,
 CASE WHEN p % 40 = 1 THEN 'SECOND' WHEN p % 40 = 0 THEN 'FIRST' ELSE t.status END AS status FROM t LEFT JOIN s ON s.job_id = t.job_id
UNION ALL SELECT -s.job_id, s.seen, 'ADDED' FROM s WHERE p % 40 = 1""",
)
def state_versions(t: Tables) -> DataFrame:
    """Records as a base and two change sets, of which the later one has rows of its own and new ones."""
    store = _store(t)
    tracking = t.spark.createDataFrame([], TRACKING_LAYOUT).unionByName(t.tracking.select(*[c for c in t.tracking.columns if c in TRACKING_LAYOUT.names]), allowMissingColumns=True)
    seen = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").alias("at"), F.min("l_partkey").alias("p"))
    version = store.commit(store.latest(), {"tracking": tracking}, 0, 0)
    for rest, name in (((0, 1), "FIRST"), ((1,), "SECOND")):
        met = seen.where((F.col("p") % 40).isin(*rest)).select("job_id", "at")
        rows = store.read(version, "tracking").join(met, "job_id").withColumns({"last_seen": F.col("at"), "status": F.lit(name)}).drop("at")
        if name == "SECOND":
            new = met.select((-F.col("job_id")).alias("job_id"), F.col("at").alias("last_seen"), F.lit("ADDED").alias("status"))
            rows = rows.unionByName(new, allowMissingColumns=True)
        version = store.commit(version, {"tracking": stage(rows.select(*TRACKING_LAYOUT.names), "changes")}, 0, 0)
    return store.read(store.latest(), "tracking").select("job_id", "last_seen", "status")


@query(
    "run_ledger",
    f"""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
 {" , ".join(f"CAST(floor(o_totalprice) AS BIGINT) + {i} AS {n}" for i, n in enumerate(COUNTER_NAMES))} FROM orders""",
)
def run_ledger(t: Tables) -> DataFrame:
    """Runs appended to the ledger in two versions, with all their counters."""
    store = _store(t)
    amount = F.floor("o_totalprice").cast("long")
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"),
        F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("status"), F.lit("manual").alias("trigger"),
        F.struct(*[(amount + i).alias(n) for i, n in enumerate(COUNTER_NAMES)]).alias("counters"),
    )
    version = store.commit(store.latest(), {"runs": runs.where("run_id % 3 = 0")}, 0, 0)
    version = store.commit(version, {"runs": runs.where("run_id % 3 <> 0")}, 0, 0)
    return store.read(version, "runs").select("run_id", "status", "counters.*")


# --- identity and whole runs -----------------------------------------------------------


def _empty(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    make = t.spark.createDataFrame
    return make([], TRACKING_LAYOUT), make([], REFS), make([], CONTENT)


@query(
    "resolve_identities",
    f"""WITH RECURSIVE {q.NORM},
arrivals AS MATERIALIZED (SELECT seq AS ord, seq + 1 AS job_new, source, source_job_id AS sid, canonical_url AS url, source_url AS raw,
 content_hash AS hash FROM norm), {q.replay('arrivals')}
SELECT ord AS seq, job AS job_id, is_new, promoted FROM folded""",
)
def resolve_identities(t: Tables) -> DataFrame:
    """Record of every posting under the sequential rule; the statement replays it row by row."""
    no_tracking, no_refs, _ = _empty(t)
    rows = stage(
        normalize_postings(t.postings).select(
            "seq", "source", "source_job_id", "canonical_url", "source_url", "content_hash"
        ),
        "postings",
    )
    return resolve_batch(rows, no_tracking, no_refs)


# Two runs: ids of the second start after the largest arrival number of the first.
_RUNS = f"""WITH RECURSIVE {q.SCORED},
timed AS (SELECT *, CASE WHEN coalesce(TRY_CAST(posted_date AS TIMESTAMP) < TIMESTAMP '1998-06-01 00:00:00', TRUE) THEN 0 ELSE 1 END AS run FROM scored),
arrivals AS MATERIALIZED (SELECT row_number() OVER (ORDER BY run, seq) AS ord,
  seq + 1 + run * (1 + (SELECT max(seq) FROM timed WHERE run = 0)) AS job_new,
  source, source_job_id AS sid, canonical_url AS url, source_url AS raw, content_hash AS hash, run, target_match, reject_reason, match_score FROM timed),
{q.replay('arrivals')},
told AS (SELECT a.*, f.job, f.is_new, f.promoted, min(a.ord) OVER (PARTITION BY f.job, a.run) = a.ord AS judged FROM arrivals a JOIN folded f USING (ord))
SELECT job AS job_id, arg_max(source, ord) FILTER (is_new OR promoted) AS source,
 (arg_max(struct_pack(v := sid), ord) FILTER (is_new OR promoted)).v AS source_job_id,
 (arg_max(struct_pack(v := CASE WHEN promoted THEN coalesce(url, raw) ELSE url END), ord) FILTER (is_new OR promoted)).v AS canonical_url,
 CASE WHEN min(run) < max(run) THEN 'SEEN' ELSE 'NEW' END AS status, TRUE AS is_active,
 arg_max(target_match, ord) FILTER (target_match IS NOT NULL) AS target_match,
 arg_max(match_score, run) FILTER (judged AND reject_reason IS NULL) AS match_score,
 count(DISTINCT concat(source, chr(1), coalesce(sid, ''))) AS n_refs, count(*) AS times_seen FROM told GROUP BY job"""


@query("incremental_run", _RUNS)
def incremental_run(t: Tables) -> DataFrame:
    """Tracking and reference counts after all postings arrive as two runs."""
    import datetime as dt

    tracking, refs, content = _empty(t)
    # judged while their texts are at hand: no text is staged, only what the runs read of a row
    rows = stage(judged_facts(normalize_postings(t.postings), t.entities, CONFIG), "rows")
    early = F.coalesce(F.col("posted_at") < moment("1998-06-01 00:00:00"), F.lit(True))
    content = content.select("job_id", "content_print")  # runs compare prints; texts of the content are not read
    base = 0
    for part, at in ((rows.where(early), AS_OF), (rows.where(~early), AS_OF + dt.timedelta(days=9))):
        resolved = stage_alone(lambda: resolve_batch(part, tracking, refs, base), "resolved")  # noqa: B023
        decisions = stage(decide(part, resolved, content, CONFIG), "decisions")
        born = part.join(resolved.where("is_new").select("seq", "job_id"), "seq")
        content = content.unionByName(born.select("job_id", "content_print"))
        refs = stage_alone(lambda: next_refs(refs, decisions, base, at), "refs")  # noqa: B023
        tracking = stage_alone(lambda: next_tracking(tracking, decisions, CONFIG, at), "tracking")  # noqa: B023
        # ids never repeat: the next run starts after the largest one in use
        base = base + 1 + (part.agg(F.max("seq")).first()[0] or 0)
    seen = refs.groupBy("job_id").agg(F.count("*").alias("n_refs"), F.sum("times_seen").alias("times_seen"))
    return tracking.join(seen, "job_id").select(
        "job_id", "source", "source_job_id", "canonical_url", "status", "is_active", "target_match", "match_score",
        "n_refs", "times_seen",
    )
