"""Orders and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.session import stage

_PLACE_BITS = 33  # of monotonically_increasing_id: the row inside its partition


def rank_order(priority: str = "priority", posted: str = "posted_at") -> list[Column]:
    """Score, then priority A before B before the rest, then newest.

    Company, title and id follow as explicit keys, so that the order is total.
    """
    letter = F.upper(F.col(priority))
    return [
        F.coalesce(F.col("match_score"), F.lit(-1)).desc(),
        F.when(letter == "A", 0).when(letter == "B", 1).otherwise(2).asc(),
        F.coalesce(F.col(posted), F.timestamp_seconds(F.lit(0))).desc(),
        F.col("company_name").asc(),
        F.col("title").asc(),
        F.col("job_id").asc(),
    ]


def ranked(postings: DataFrame, priority: str = "priority") -> DataFrame:
    """The whole table in rank order (one range exchange)."""
    return postings.orderBy(*rank_order(priority))


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add exact places 1, 2, 3, ... in a total order.

    Rows are dealt by range, sorted and staged; a row's place is the number of rows in the ranges before
    its own plus its place inside. Only the range sizes, one row each, go through a single task.
    """
    columns = [c for c in rows.columns if c != name]
    placed = stage(rows.select(*columns).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", _PLACE_BITS))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return placed.join(before, "_range").select(*columns, (F.col("_before") + inside).alias(name))


def top_scored(postings: DataFrame, n: int = 10, priority: str = "priority") -> DataFrame:
    """Best ``n`` scored rows; each task keeps only ``n`` before the final merge."""
    return postings.where(F.col("match_score").isNotNull()).orderBy(*rank_order(priority)).limit(n)


def listing_order() -> list[Column]:
    return [F.col("match_score").desc_nulls_last(), F.col("company_name").asc(), F.col("title").asc()]


def newest_since(postings: DataFrame, since: Column, n: int = 100) -> DataFrame:
    """Newest ``n`` rows first seen strictly after ``since``."""
    return (
        postings.where(F.col("first_seen") > since)
        .orderBy(F.col("first_seen").desc(), *listing_order(), F.col("job_id").asc())
        .limit(n)
    )


def latest_errors(errors: DataFrame, n: int | None = 20) -> DataFrame:
    """The latest ``n`` errors, latest first; all of them without ``n``."""
    latest = errors.orderBy(F.col("error_id").desc())
    return latest if n is None else latest.limit(n)
