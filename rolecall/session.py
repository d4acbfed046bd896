"""Session defaults and the lineage-cutting helper."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings every job relies on for right results (UTC) or for scale (AQE).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # start with many small shuffle partitions; AQE merges them at run time
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def build_session(app: str = "rolecall", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with :data:`DEFAULT_CONF`; ``conf`` overrides it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to reliable storage.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without that
    setting (tests) falls back to a temporary folder; a cluster must name a shared one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="rolecall-ckpt-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of :func:`cut_lineage`, for tables a job stages for itself."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return context.getCheckpointDir()


#: Since Spark 4.1: files of the shuffles of a job are removed as the job ends, not when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # what is read from now on is the table, so nothing needs the shuffles that made it
    with _tidied(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a checkpoint the result is columnar: later readers load only the columns they
    use, and the planner knows its size.
    """
    staged, path = _staged(df, name)
    _note(path)
    return staged


def _note(path: str) -> None:
    paths = getattr(_open, "paths", None)
    if paths is not None:
        paths.append(path)


def stage_alone(build: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """:func:`stage` of what ``build`` gives; tables that it stages on the way are dropped, as nothing reads them any more."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        df = build()
        staged, path = _staged(df, name)
        for made in _open.paths:
            _drop(df.sparkSession, made)
    finally:
        _open.paths = outer
    _note(path)
    return staged


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def stage_observed(df: DataFrame, name: str, columns: list[Column]) -> tuple[DataFrame, dict]:
    """:func:`stage`, and aggregates over the rows worked out while they are written: no second scan."""
    seen = Observation()
    staged = stage(df.observe(seen, *columns), name)
    return staged, seen.get
