"""One row per group: first arrivals, best sources, latest rows.

Each is an aggregate over a struct, so a task sends at most one row per group and no group,
however large, is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.identity import source_tier

PROMOTED_COLUMNS = ("source", "source_job_id", "source_url", "canonical_url")


def _pick(df: DataFrame, keys: list[str], choose, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(choose(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])
        .select(*df.columns)
    )


def first_per(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """First arrival of each group, whole row. Null keys form one group."""
    return _pick(df, keys, F.min_by, F.col(seq))


def latest_per(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Latest arrival of each group, whole row."""
    return _pick(df, keys, F.max_by, F.col(seq))


def promoted_source(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Source columns of the first arrival within each group's best tier."""
    best = F.min_by(F.struct(*PROMOTED_COLUMNS), F.struct(source_tier(F.col("source")), F.col(seq)))
    return df.groupBy(key).agg(best.alias("_b")).select(
        key, *[F.col("_b").getField(c).alias(c) for c in PROMOTED_COLUMNS]
    )


def latest_review_rows(errors: DataFrame, seq: str = "error_id") -> DataFrame:
    """Keep one MANUAL_REVIEW row per (source, company), the latest; all other errors stay."""
    review = F.col("error_type").eqNullSafe("MANUAL_REVIEW")
    kept = latest_per(errors.where(review), ["source", "company"], seq)
    return kept.unionByName(errors.where(~review))


def last_finished_run(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") != "RUNNING").orderBy(F.col("run_id").desc()).limit(1)
