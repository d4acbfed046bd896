"""The incremental run as a stream: every micro-batch of a file source is one run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolecall.config import SearchConfig
from rolecall.plans.run import ingest
from rolecall.plans.state import StateStore
from rolecall.schemas import FETCH_RESULTS, RAW
from rolecall.session import stage
from rolecall.sources.registry import compact_seq


def read_raw_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """Raw-layout files as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def start_ingest(
    stream: DataFrame,
    store: StateStore,
    cfg: SearchConfig,
    checkpoint: str,
    as_of: Callable[[int], dt.datetime],
    name: str = "ingest",
    **trigger: object,
) -> StreamingQuery:
    """Ingest every micro-batch; ``as_of`` gives the moment a batch counts as seen.

    A batch and its number are committed together, so a batch Spark replays after a failure
    is recognised and skipped: each one is applied exactly once.
    """
    mark = f"stream:{name}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.latest().marks.get(mark, -1) >= batch_id:
            return
        # numbers from files only order the rows: two files may use the same ones
        placed = batch.withColumn("_place", F.monotonically_increasing_id())
        ordered = placed.orderBy(F.col("seq").asc_nulls_last(), "_place").drop("_place")
        rows = stage(ordered.withColumn("seq", F.monotonically_increasing_id()), f"{name}-{batch_id}")
        results = (
            rows.groupBy("source")
            .agg(F.count("*").alias("n_jobs"))
            .select(F.lit(-1).cast("long").alias("seq"), "source", F.lit("OK").alias("status"), "n_jobs")
        )
        ingest(
            store, cfg, compact_seq(rows), as_of(batch_id),
            results=results.to(FETCH_RESULTS), trigger="stream", marks={mark: batch_id},
        )

    return (
        stream.writeStream.queryName(name)
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
