"""Report queries, as tables of metrics and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.operators.aggregates import new_since, state_totals, status_counts
from rolecall.operators.firsts import last_finished_run
from rolecall.operators.rank import latest_errors, newest_since
from rolecall.schemas import COUNTER_NAMES

MESSAGE_WIDTH = 60


def metric_rows(one_row: DataFrame, names: list[str]) -> DataFrame:
    """Turn a one-row table into ``(metric, value)`` rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])
    return one_row.select(F.inline(pairs))


def run_report(runs: DataFrame) -> DataFrame:
    """Counters of the last finished run."""
    return metric_rows(last_finished_run(runs).select("counters.*"), list(COUNTER_NAMES))


def status_report(
    tracking: DataFrame, refs: DataFrame, entities: DataFrame, sources: DataFrame, errors: DataFrame, as_of: Column
) -> DataFrame:
    """Totals of all state tables and one row per record status."""
    totals = state_totals(tracking, refs, entities, sources, errors, as_of)
    by_status = status_counts(tracking).select(
        F.concat(F.lit("status:"), "status").alias("metric"), F.col("n").alias("value")
    )
    return metric_rows(totals, totals.columns).unionByName(by_status)


def status_lines(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Source rows and the last finished run of the status report: ``(line, status, jobs_found, at)``."""
    off = F.when(~F.coalesce("enabled", F.lit(False)), " (off in config)").otherwise("")
    rows = sources.select(
        F.col("source").alias("line"), F.concat(F.coalesce("status", F.lit("")), off).alias("status"),
        F.coalesce("jobs_found", F.lit(0).cast("long")).alias("jobs_found"), F.col("last_run_at").alias("at"),
    )
    last = last_finished_run(runs).select(
        F.concat(F.lit("run #"), F.col("run_id").cast("string")).alias("line"), "status",
        F.col("counters.jobs_found").alias("jobs_found"), F.col("started_at").alias("at"),
    )
    return rows.unionByName(last)


def source_listing(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source")


def entity_listing(entities: DataFrame, enabled_only: bool = False) -> DataFrame:
    kept = entities.where("enabled") if enabled_only else entities
    return kept.select("name", "domain", "careers_url", "priority", "enabled", "ats").orderBy("priority", "name")


def discovery_listing(discovery: DataFrame) -> DataFrame:
    return discovery.orderBy("company_name")


def since_moment(runs: DataFrame, as_of: Column, hours: int | None = None) -> DataFrame:
    """One row ``since``: so many hours ago, else the last run's start, else seven days ago."""
    if hours:
        return runs.sparkSession.range(1).select((as_of - F.make_dt_interval(hours=F.lit(hours))).alias("since"))
    start = last_finished_run(runs).agg(F.max("started_at").alias("started_at"))
    return start.select(F.coalesce("started_at", as_of - F.expr("INTERVAL 7 DAYS")).alias("since"))


def new_report(tracking: DataFrame, since: Column, as_of: Column) -> DataFrame:
    """Number of new records since a moment, in a day and in a week: ``(metric, value)``."""
    moments = {
        "since_last_run": since,
        "last_24h": as_of - F.expr("INTERVAL 1 DAY"),
        "last_7d": as_of - F.expr("INTERVAL 7 DAYS"),
    }
    return metric_rows(new_since(tracking, moments), list(moments))


def new_rows(records: DataFrame, since: Column, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The newest rows to show and, as one row ``n_more``, how many are left out."""
    left = records.agg(
        F.greatest(F.count_if(F.col("first_seen") > since) - F.lit(n), F.lit(0).cast("long")).alias("n_more")
    )
    return newest_since(records, since, n), left


def error_report(errors: DataFrame, n: int = 20) -> DataFrame:
    """Latest errors with the message cut to a table's width."""
    return latest_errors(errors, max(1, n)).withColumn("message", F.substring("message", 1, MESSAGE_WIDTH))
