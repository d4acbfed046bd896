"""Sources plugged in by key, and how a run collects them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.schemas import ERRORS, FETCH_RESULTS, RAW
from rolecall.session import stage
from rolecall.sources.feeds import broken_rows, narrow
from rolecall.sources.triage import review_queue


@dataclass(frozen=True)
class Scope:
    """What a run asks its sources for."""

    entities: DataFrame
    company: str | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Source:
    """A source: ``read(spark, scope)`` returns raw rows, or fetch results if it has none.

    ``mode`` is ``board`` (asked once) or ``company`` (asked per entity). ``transform`` may
    reshape the raw rows before normalisation.
    """

    key: str
    read: Callable[[SparkSession, Scope], DataFrame]
    mode: str = "board"
    transform: Callable[[DataFrame], DataFrame] | None = None


_REGISTRY: dict[str, Source] = {}


def register_source(source: Source) -> Source:
    if not source.key:
        raise ValueError("a source needs a key")
    if source.mode not in ("board", "company"):
        raise ValueError("mode must be 'board' or 'company'")
    _REGISTRY[source.key] = source
    return source


def available_sources() -> list[str]:
    return sorted(_REGISTRY)


def get_source(key: str) -> Source | None:
    return _REGISTRY.get(key)


def select_sources(
    configured: dict[str, bool], keys: list[str] | None = None, mode: str = "both"
) -> tuple[list[Source], list[str]]:
    """Runnable sources in configured order, and asked-for keys nothing is registered for.

    Enabled sources are taken, or exactly the listed ones even if switched off; listed keys
    that are not configured are ignored.
    """
    asked = [k for k, enabled in configured.items() if (k in keys if keys else enabled)]
    missing = [k for k in asked if k not in _REGISTRY]
    runnable = [_REGISTRY[k] for k in asked if k in _REGISTRY and mode in ("both", _REGISTRY[k].mode)]
    return runnable, missing


def choose_sources(
    configured: DataFrame, installed: DataFrame, listed: DataFrame | None = None, mode: str = "both"
) -> DataFrame:
    """:func:`select_sources` for a table of sources: ``configured`` (source, enabled) with ``outcome`` RUN,
    OTHER_MODE or NOT_AVAILABLE for each asked-for one. ``installed`` has (source, mode); ``listed`` (source) asks
    for exactly these, switched on or not."""
    asked = configured.where("enabled") if listed is None else configured.join(listed.select("source").distinct(), "source", "left_semi")
    fits = F.lit(True) if mode == "both" else F.col("mode") == mode
    outcome = F.when(F.col("mode").isNull(), "NOT_AVAILABLE").when(fits, "RUN").otherwise("OTHER_MODE")
    return asked.join(installed.select("source", "mode"), "source", "left").select("source", outcome.alias("outcome"))


def entity_results(rows: DataFrame, entities: DataFrame, source: str) -> DataFrame:
    """Fetch results of a company-by-company source that returned ``rows``: one for each entity asked for, with
    its rows; rows of no such entity count under a null company."""
    hint = F.coalesce(F.nullif(F.col("company_hint"), F.lit("")), F.col("company_name"))
    counts = rows.groupBy(hint.alias("name")).agg(F.count("*").alias("n_jobs"))
    asked = entities.select("name").distinct()
    known = asked.join(counts, "name", "left").select(F.col("name").alias("company"), F.coalesce("n_jobs", F.lit(0).cast("long")).alias("n_jobs"))
    other = counts.join(asked, "name", "left_anti").agg(F.sum("n_jobs").alias("n_jobs")).where("n_jobs > 0")
    found = known.unionByName(other.select(F.lit(None).cast("string").alias("company"), "n_jobs"))
    return found.select(F.lit(-1).cast("long").alias("seq"), F.lit(source).alias("source"), F.lit("OK").alias("status"), "company", "n_jobs").to(FETCH_RESULTS)


def mark_not_available(missing: DataFrame) -> DataFrame:
    """Fetch results for asked-for sources (column ``source``) nothing is registered for."""
    return missing.select(
        F.lit(-1).cast("long").alias("seq"), "source", F.lit("NOT_AVAILABLE").alias("status"),
        F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("url"),
        F.lit("No reader is installed for this source").alias("reason"),
        F.lit(None).cast("string").alias("action"), F.lit(0).cast("long").alias("n_jobs"),
    )


@dataclass(frozen=True)
class Collected:
    raw: DataFrame
    results: DataFrame
    errors: DataFrame


BLOCK_BITS = 20


def compact_seq(rows: DataFrame, start: int = 0) -> DataFrame:
    """Close the wide gaps in ``seq`` while keeping its order.

    Numbers are cut into blocks of 2^20; used blocks are numbered 0, 1, 2, … from ``start``.
    Only the list of used blocks (about one per million rows) is sorted; rows do not move.
    """
    block = F.call_function("shiftright", F.col("seq"), F.lit(BLOCK_BITS))
    inside = F.col("seq").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    used = rows.select(block.alias("_block")).distinct()
    ranks = used.withColumn("_rank", F.row_number().over(Window.orderBy("_block")) - F.lit(1))
    return (
        rows.withColumn("_block", block)
        .join(ranks, "_block")
        .withColumn("seq", (F.col("_rank").cast("long") + F.lit(start)) * F.lit(1 << BLOCK_BITS) + inside)
        .select(*rows.columns)
    )


def blocks_used(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and of used ``seq`` blocks."""
    block = F.call_function("shiftright", F.col("seq"), F.lit(BLOCK_BITS))
    found = rows.agg(F.count("*"), F.count_distinct(block)).first()
    return found[0], found[1]


def collect_sources(spark: SparkSession, sources: list[Source], missing: list[str], scope: Scope) -> Collected:
    """Read every source on its own; a failing one becomes a FAILED result and an error row.

    A source is staged while it is read, so that a bad file fails here and not in the run. One that
    returns (rows, broken lines) has an INGEST error row for every broken line.
    """
    quarantined: list[DataFrame] = []
    raws: list[DataFrame] = []
    results = [mark_not_available(spark.createDataFrame([(k,) for k in missing], "source string"))]
    failures: list[tuple[str, str, str]] = []
    start = 0
    for source in sources:
        try:
            rows = source.read(spark, scope)
            if isinstance(rows, tuple):
                rows, broken = rows
                quarantined.append(broken_rows(broken, source.key).drop("seq").to(ERRORS))
            if "status" in rows.columns:
                results.append(stage(rows.to(FETCH_RESULTS), source.key))
                continue
            rows = source.transform(rows) if source.transform else rows
            rows = narrow(rows, scope.company if source.mode == "board" else None, None)
            rows = rows.withColumn("mode", F.lit(source.mode)).to(RAW)
            staged = stage(rows, source.key)
            n, blocks = blocks_used(staged)
            raws.append(compact_seq(staged, start))
            start += blocks
            if source.mode == "company":
                results.append(entity_results(staged, scope.entities, source.key))
            else:
                results.append(spark.createDataFrame([(-1, source.key, "OK", None, None, None, None, n)], FETCH_RESULTS))
        except Exception as problem:  # noqa: BLE001 - one source must never stop the others
            failures.append((source.key, type(problem).__name__, str(problem)))
    results.append(
        spark.createDataFrame(
            [(-1, key, "FAILED", None, None, text, "Not retried; see the error.", 0) for key, _, text in failures],
            FETCH_RESULTS,
        )
    )
    union = results[0]
    for part in results[1:]:
        union = union.unionByName(part)
    raw = raws[0] if raws else spark.createDataFrame([], RAW)
    for part in raws[1:]:
        raw = raw.unionByName(part)
    errors = spark.createDataFrame(
        [(None, None, key, None, None, kind, None, text, None) for key, kind, text in failures], ERRORS
    )
    for part in quarantined:
        errors = errors.unionByName(part)
    return Collected(raw, union, errors)


def file_feed(key: str, read: Callable[[SparkSession], DataFrame], mode: str = "board") -> Source:
    """A source over files that needs no scope."""
    return Source(key, lambda spark, scope: read(spark), mode)


def careers_review(key: str = "generic") -> Source:
    """Company-by-company source that only queues careers pages for review."""
    return Source(key, lambda spark, scope: review_queue(scope.entities, key), "company")
