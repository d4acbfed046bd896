"""Postings, entities and state tables derived from whole test tables.

The statements run unchanged in Spark SQL and DuckDB. Names in braces are tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from rolecall.config import SearchConfig

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

CONFIG = SearchConfig(
    roles=("small widget", "red plate", "hot ring economy", "blue ring promo", "old rod"),
    locations=("Asia", "NATION_3", "Remote"),
    location_aliases={"Asia": ("NATION_7",)},
    countries=("Europe",),
    experience_min=3,
    experience_max=6,
    skills=("economy", "the", "der"),
    preferred_skills=("les", "que", "small"),
    excluded_keywords=("promo",),
    employment_types=("full_time", "contract"),
)

AS_OF = dt.datetime(2001, 8, 2, tzinfo=dt.UTC)

# One raw posting per order. The customer number drives links and source ids, pairs of
# customers share name, title and place, and the order number varies the spelling. Texts and
# skills go by the order number, so that all documents and parts are reached.
POSTINGS = """
SELECT o.o_orderkey AS seq,
 CASE o.o_orderstatus WHEN 'F' THEN 'company_careers' WHEN 'O' THEN 'greenhouse' ELSE 'indeed' END AS source,
 CASE WHEN o.k % 6 = 5 THEN 'company' ELSE 'board' END AS mode,
 CASE WHEN (o.e + o.k) % 5 = 0 THEN NULL ELSE concat('id-', CAST(o.e AS STRING)) END AS source_job_id,
 CASE WHEN o.h % 17 = 0 THEN 'Unlisted  Works Ltd'
  ELSE concat(s.s_name, CASE o.k % 3 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN '  Inc' ELSE '' END) END AS company_name,
 CASE WHEN o.k % 6 = 5 THEN concat(s.s_name, ' Group') ELSE NULL END AS company_hint,
 CASE WHEN o.k % 4 = 0 THEN concat('https://www.S', CAST(s.s_suppkey AS STRING), '.example.com/about') ELSE NULL END AS company_domain,
 concat(' ', p.p_name, '  ', lower(p.p_type), ' ', CAST(o.h % 300 AS STRING)) AS title,
 CASE WHEN o.h % 11 = 0 THEN NULL WHEN o.h % 13 = 0 THEN 'Remote' ELSE concat(n.n_name, ',  ', r.r_name) END AS location,
 CASE o.h % 5 WHEN 0 THEN 'Hybrid' WHEN 1 THEN ' On-Site' WHEN 2 THEN 'flexible' ELSE NULL END AS remote_status,
 CASE o.e % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN ' Contract ' WHEN 2 THEN 'Internship' ELSE NULL END AS employment_type,
 CASE WHEN o.h % 7 = 0 THEN NULL WHEN o.h % 19 = 0 THEN concat(CAST(o.h % 6 + 3 AS STRING), '.7') ELSE CAST(o.h % 6 AS STRING) END AS experience_min,
 CASE WHEN o.h % 7 = 0 THEN 'open' ELSE CAST(o.h % 6 + 2 AS STRING) END AS experience_max,
 concat('https://Jobs.example.com/p/', CAST(o.e AS STRING), CASE o.k % 4 WHEN 0 THEN '?utm_source=x&b=2&a=1' WHEN 1 THEN '/?a=1&b=2' WHEN 2 THEN '?b=2&a=1#top' ELSE '?ref=m&a=1&b=2' END) AS url,
 CASE WHEN o.h % 8 = 0 THEN NULL ELSE d.text END AS description,
 CASE WHEN o.h % 6 = 0 THEN NULL ELSE concat(p2.p_type, '; ', p2.p_brand, ',, the') END AS skills,
 CASE WHEN o.k % 2 = 0 THEN concat('USD ', CAST(o.o_totalprice AS STRING)) ELSE NULL END AS salary_max,
 CASE o.k % 4 WHEN 0 THEN CAST(CAST(o.o_orderdate AS DATE) AS STRING)
  WHEN 1 THEN replace(CAST(CAST(o.o_orderdate AS DATE) AS STRING), '-', '/') WHEN 2 THEN 'soon' ELSE NULL END AS posted_date
FROM (SELECT *, h % (SELECT count(*) FROM {supplier}) AS sk, h % (SELECT count(*) FROM {part}) AS pk,
  o_orderkey % (SELECT count(*) FROM {part}) AS qk, o_orderkey % (SELECT count(*) FROM {documents}) AS dk
  FROM (SELECT *, o_custkey AS e, CAST(floor(o_custkey / 2) AS BIGINT) AS h, o_orderkey % 12 AS k FROM {orders}) x) o
 JOIN {supplier} s ON s.s_suppkey = o.sk
 JOIN {nation} n ON n.n_nationkey = s.s_nationkey
 JOIN {region} r ON r.r_regionkey = n.n_regionkey
 JOIN {part} p ON p.p_partkey = o.pk
 JOIN {part} p2 ON p2.p_partkey = o.qk
 JOIN {documents} d ON d.doc_id = o.dk
"""

ENTITIES = """
SELECT s_suppkey AS entity_id, s_name AS name,
 concat('s', CAST(s_suppkey AS STRING), '.example.com') AS domain,
 CASE WHEN s_suppkey % 3 = 0 THEN concat('https://s', CAST(s_suppkey AS STRING), '.example.com/careers') ELSE NULL END AS careers_url,
 CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS priority,
 s_acctbal > 0 AS enabled, CAST(NULL AS STRING) AS ats
FROM {supplier}
"""

# Stored records: one per order, with a life of up to 40 days and a score for most.
TRACKING = """
SELECT o_orderkey AS job_id, o_custkey AS entity_id,
 CASE o_orderstatus WHEN 'F' THEN 'company_careers' WHEN 'O' THEN 'greenhouse' ELSE 'indeed' END AS source,
 concat('id-', CAST(o_custkey AS STRING)) AS source_job_id,
 concat('Supplier#', lpad(CAST(o_custkey % 120 AS STRING), 9, '0')) AS company_name,
 concat(o_orderpriority, ' ', CAST(o_orderkey % 50 AS STRING)) AS title,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('https://t.example.com/', CAST(o_orderkey AS STRING)) END AS source_url,
 concat('https://c.example.com/', CAST(o_custkey AS STRING)) AS canonical_url,
 CASE WHEN o_orderkey % 5 = 0 THEN 'SEEN' WHEN o_orderkey % 11 = 0 THEN 'INACTIVE' WHEN o_orderkey % 23 = 0 THEN 'EXPIRED' ELSE 'NEW' END AS status,
 o_orderkey % 11 <> 0 AS is_active,
 o_orderdate AS first_seen,
 CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS TIMESTAMP) AS last_seen,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS INT) END AS match_score,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS posted_at,
 o_orderdate AS updated_at
FROM {orders}
"""

# Error ledger: one row per event.
ERRORS = """
SELECT event_id AS error_id, concat('src', CAST(user_id % 7 AS STRING)) AS source,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('Customer#', lpad(CAST(user_id AS STRING), 9, '0')) END AS company,
 CASE event_type WHEN 'error' THEN 'MANUAL_REVIEW' WHEN 'view' THEN 'MANUAL_REVIEW' ELSE upper(event_type) END AS error_type,
 concat(props, ' value ', CAST(value AS STRING), ' reported by user ', CAST(user_id AS STRING), ' while collecting') AS message,
 ts AS occurred_at
FROM {events}
"""

# Fetch outcomes: one per event.
RESULTS = """
SELECT event_id AS seq, concat('src', CAST(user_id % 7 AS STRING)) AS source,
 CASE event_type WHEN 'error' THEN CASE WHEN user_id % 7 < 2 THEN 'FAILED' ELSE 'MANUAL_REVIEW' END
  WHEN 'signup' THEN CASE WHEN user_id % 7 < 5 THEN 'NOT_AVAILABLE' ELSE 'OK' END
  ELSE 'OK' END AS status,
 concat('Customer#', lpad(CAST(user_id AS STRING), 9, '0')) AS company,
 CASE WHEN event_type IN ('error', 'signup') AND event_id % 3 = 0 THEN concat('why ', CAST(event_id AS STRING)) ELSE NULL END AS reason,
 CAST(floor(value) AS BIGINT) AS n_jobs
FROM {events}
"""

# Fetch log: one response per event.
RESPONSES = """
SELECT event_id AS seq, concat('https://h', CAST(user_id AS STRING), '.example.com/') AS url,
 CASE event_id % 9 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 503 WHEN 4 THEN 451 WHEN 5 THEN 418 ELSE 200 END AS status,
 CASE WHEN user_id % 4 = 0 THEN concat('Please Verify you are HUMAN ', props) ELSE props END AS body,
 CAST(user_id % 4 AS INT) AS attempt
FROM {events}
"""

# Sightings of records: one per event; a record is a (user, kind) pair.
SIGHTINGS = """
SELECT event_id AS seq, concat(CAST(user_id AS STRING), '-', event_type) AS record,
 CASE event_type WHEN 'view' THEN 'company_careers' WHEN 'click' THEN 'greenhouse' ELSE 'indeed' END AS source,
 CAST(user_id AS STRING) AS source_job_id,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('https://s.example.com/', CAST(event_id AS STRING)) END AS source_url,
 concat('https://c.example.com/', CAST(user_id AS STRING)) AS canonical_url, user_id, event_type, value, ts
FROM {events}
"""

SQL = {
    "postings": POSTINGS, "entities": ENTITIES, "tracking": TRACKING, "errors": ERRORS,
    "results": RESULTS, "responses": RESPONSES, "sightings": SIGHTINGS,
}


class Tables:
    """Test tables of one folder, and the tables above derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in SQL:
            return self.sql(SQL[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        if text is POSTINGS:
            # all joins of the view may be broadcast; dealing the narrow side spreads the work on the joined texts
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            used["orders"] = used["orders"].repartition(tasks, "o_orderkey")
        return self.spark.sql(text, **used)


def duck(text: str) -> str:
    """The statement for DuckDB, where the tables go by their own names."""
    return text.format(**{t: t for t in TABLES})
