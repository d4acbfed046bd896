"""Table layouts. Raw scalars are strings, so that a bad value reaches a tolerant cast."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
}


def _table(columns: str) -> T.StructType:
    """Layout from ``name type, …`` (usable before a session exists)."""
    pairs = (part.split() for part in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


#: Payload fields every source maps to. ``skills`` may hold a JSON array or delimited text.
PAYLOAD_FIELDS = (
    "source_job_id", "company_name", "company_domain", "title", "url", "location", "city",
    "country", "remote_status", "employment_type", "department", "experience_min",
    "experience_max", "description", "skills", "salary_min", "salary_max", "salary_currency",
    "posted_date", "updated_date", "ats", "_fixture",
)

PAYLOAD = T.StructType([T.StructField(name, T.StringType()) for name in PAYLOAD_FIELDS])

#: A raw row: arrival order, source, link and hint beside the payload.
RAW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("company_hint", T.StringType()),
        *PAYLOAD.fields,
    ]
)

ENTITIES = _table(
    "entity_id long, name string, domain string, careers_url string, priority string, "
    "enabled boolean, ats string, created_at timestamp, updated_at timestamp"
)

FETCH_RESULTS = _table(
    "seq long, source string, status string, company string, url string, reason string, "
    "action string, n_jobs long"
)

#: Written once per record and never rewritten.
CONTENT = _table(
    "job_id long, content_hash string, company_name string, title string, location string, "
    "country string, city string, remote_status string, employment_type string, "
    "department string, experience_min int, experience_max int, description string, "
    "skills strings, salary_min double, salary_max double, salary_currency string, "
    "posted_date string, posted_at timestamp, updated_date string, ats string, "
    "raw_hash string, is_fixture boolean, content_print string, first_seen timestamp"
)

#: The small changing part of a record.
TRACKING = _table(
    "job_id long, content_hash string, source string, source_job_id string, "
    "source_url string, canonical_url string, first_seen timestamp, last_seen timestamp, "
    "status string, is_active boolean, target_match string, entity_id long, "
    "match_confidence string, match_score int, match_reasons strings, "
    "match_warnings strings, updated_at timestamp"
)

REFS = _table(
    "job_id long, source string, source_job_id string, ref_id long, source_url string, "
    "first_seen timestamp, last_seen timestamp, times_seen long"
)

SOURCES = _table(
    "source string, source_type string, enabled boolean, status string, "
    "last_run_at timestamp, last_success_at timestamp, last_error string, jobs_found long"
)

ERRORS = _table(
    "error_id long, run_id long, source string, company string, url string, "
    "error_type string, http_status int, message string, occurred_at timestamp"
)

COUNTER_NAMES = (
    "companies_total", "companies_processed", "companies_failed", "sources_selected",
    "sources_processed", "sources_not_available", "jobs_found", "new_jobs", "updated_jobs",
    "duplicates", "filtered_out", "below_threshold", "high_match", "manual_review", "errors",
)

RUNS = _table(
    "run_id long, started_at timestamp, finished_at timestamp, status string, "
    "trigger string"
).add("counters", T.StructType([T.StructField(n, T.LongType()) for n in COUNTER_NAMES]))

DISCOVERY = _table(
    "company_name string, careers_url string, ats string, confidence string, "
    "status string, jobs_url string, discovered_at timestamp"
)
