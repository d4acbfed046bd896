"""Export rows and views."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.config import SearchConfig
from rolecall.functions.text import blank_to_null, experience_label
from rolecall.operators.match import best_links, with_priority
from rolecall.operators.predicates import is_high_match, listed
from rolecall.operators.rank import latest_errors, numbered, rank_order
from rolecall.plans.reports import discovery_listing, entity_listing, source_listing

# The display columns and their order.
COLUMNS = (
    "Company", "Priority", "Job Title", "Location", "Remote", "Experience", "Match Score",
    "Match Reasons", "Posted Date", "First Seen", "Source", "ATS", "Canonical URL",
    "Application URL", "Status",
)
# How a working mode is shown.
MODE_LABELS = {"remote": "Yes (remote)", "hybrid": "Hybrid", "onsite": "No (onsite)"}


def records(content: DataFrame, tracking: DataFrame) -> DataFrame:
    """Content and tracking of every record, side by side."""
    return content.drop("content_hash", "first_seen").join(tracking, "job_id")


def export_rows(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fifteen display columns, after the columns to ``keep``.

    Expects record columns with ``priority`` and ``application_url``.
    """
    text = lambda c, default="": F.coalesce(blank_to_null(F.col(c)), F.lit(default))
    mode = F.lit("Unknown")
    for key, label in MODE_LABELS.items():
        mode = F.when(F.col("remote_status") == key, label).otherwise(mode)
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.coalesce("match_reasons", none),
        F.transform(F.coalesce("match_warnings", none), lambda w: F.concat(F.lit("WARNING: "), w)),
    )
    values = (
        F.col("company_name"),
        F.col("priority"),
        F.col("title"),
        text("location", "Not listed"),
        mode,
        experience_label(F.col("experience_min"), F.col("experience_max")),
        F.coalesce(F.col("match_score").cast("string"), F.lit("")),
        F.array_join(reasons, "; "),
        text("posted_date", "Not listed"),
        F.col("first_seen"),
        F.col("source"),
        text("ats"),
        F.coalesce(blank_to_null(F.col("canonical_url")), blank_to_null(F.col("source_url")), F.lit("")),
        text("application_url"),
        F.concat("status", F.when(F.col("is_fixture"), " [FIXTURE]").otherwise("")),
    )
    return records.select(*keep, *[v.alias(name) for v, name in zip(values, COLUMNS, strict=True)])


def ranked_views(
    content: DataFrame, tracking: DataFrame, refs: DataFrame, entities: DataFrame, sources: DataFrame,
    errors: DataFrame, discovery: DataFrame, cfg: SearchConfig, error_limit: int | None = None,
) -> dict[str, DataFrame]:
    """The seven views. Those of records carry ``rank``, their place among all active records, which are
    joined, numbered and staged once for all three.

    The application link is the best one over all references of a record.
    """
    active = listed(tracking, active_only=True)
    links = best_links(active.select("job_id", "source", "source_url", "canonical_url"), refs)
    rows = with_priority(records(content, active).join(links, "job_id"), entities, default="")
    rows = numbered(rows, rank_order())
    view = lambda part: export_rows(part, keep=("rank",))
    return {
        "new_jobs": view(rows.where(F.col("status") == "NEW")),
        "high_match": view(rows.where(is_high_match(cfg))),
        "all_active": view(rows),
        "companies": entity_listing(entities),
        "sources": source_listing(sources),
        "errors": latest_errors(errors, error_limit),
        "discovery": discovery_listing(discovery),
    }


def export_views(
    content: DataFrame, tracking: DataFrame, refs: DataFrame, entities: DataFrame, sources: DataFrame,
    errors: DataFrame, discovery: DataFrame, cfg: SearchConfig, error_limit: int | None = None,
) -> dict[str, DataFrame]:
    """The seven views, each in its own order."""
    views = ranked_views(content, tracking, refs, entities, sources, errors, discovery, cfg, error_limit)
    return {name: v.orderBy("rank").drop("rank") if "rank" in v.columns else v for name, v in views.items()}


def write_views(views: dict[str, DataFrame], root: str, fmt: str = "parquet", one_file: bool = False) -> list[str]:
    """Write each view to its own folder; file order follows the view's order.

    ``one_file`` moves a view through a single task and is meant for small exports only.
    """
    paths = []
    for name, df in views.items():
        path = f"{root.rstrip('/')}/{name}"
        out = df.coalesce(1) if one_file else df
        out.write.mode("overwrite").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
        paths.append(path)
    return paths


CSV = {"header": "true", "multiLine": "true", "escape": '"'}


@dataclass(frozen=True)
class Part:
    """One file of an ordered export: its name, the place of its first row, its number of rows."""

    file: str
    first: int
    rows: int


def write_in_order(rows: DataFrame, order: list[Column], root: str) -> list[Part]:
    """``rows`` as CSV files that are in order one after the other, and ``_manifest.json``, which names them in
    that order with the place of each one's first row. No task holds more than its range of rows."""
    spark = rows.sparkSession
    rows.orderBy(*order).write.mode("overwrite").options(**CSV).csv(root)
    found = spark.read.options(**CSV).schema(rows.schema).csv(root).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
    parts, at = [], 1
    for name, n in sorted((tuple(r) for r in found.collect()), key=lambda p: int(p[0].split("-")[1])):  # part-<range>-…
        parts.append(Part(name, at, n))
        at += n
    fs, path = _manifest(spark, root)
    out = fs.create(path, True)
    try:
        out.write(bytearray(json.dumps([p.__dict__ for p in parts]).encode()))
    finally:
        out.close()
    return parts


def _manifest(spark: SparkSession, root: str):
    """File system and path of the manifest; its leading underscore hides it from readers of the rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_manifest.json")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_manifest(spark: SparkSession, root: str) -> list[Part]:
    fs, path = _manifest(spark, root)
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [Part(**p) for p in json.loads(text)]


def read_in_order(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of an ordered export with their place ``rank``; each file is numbered by itself."""
    first = spark.createDataFrame([(p.file, p.first) for p in read_manifest(spark, root)], "_file string, _first long")
    rows = spark.read.options(**CSV).schema(schema).csv(root)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return rows.withColumn("_place", place).join(first, "_file").select(*schema.names, (F.col("_first") + F.col("_place") - 1).alias("rank"))
