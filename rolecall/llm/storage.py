"""Tables that a job stages for itself, in the folder that the cluster names.

The folder is ``spark.checkpoint.dir``; all executors share it. Only where the setting is
missing and the session is local (tests) is a folder of our own used. A staged table outlives
lost executors. Each :class:`Staging` has a folder of its own, which the caller may drop once the
result is written; tables are never changed after they are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Staging:
    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="rolecall-")
        self.spark = spark
        self.id = f"{name}_{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._tables: list[str] = []
        self._paths: dict[str, list[str]] = {}
        self.path = f"{base.rstrip('/')}/{self.id}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as Parquet, read back with its own schema."""
        self._n += 1
        path = f"{self.path}/{name}-{self._n}"
        self._paths.setdefault(name, []).append(f"{name}-{self._n}")
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_sorted(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """``df`` as a table of ``buckets`` hash buckets, sorted inside: a join on ``keys`` reads
        it without a shuffle."""
        table = f"{self.id}_{name}"
        self._tables.append(name)
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def forget(self, name: str) -> None:
        """Drop a sorted table: its entry in the session and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.id}_{name}")
        self.remove(name)

    def drop(self, name: str) -> None:
        """Delete the staged tables whose name begins with ``name``: nothing may read them any more."""
        for known in [k for k in self._paths if k.startswith(name)]:
            for place in self._paths.pop(known):
                self.remove(place)

    def close(self) -> None:
        """Drop everything staged, once what was made of it is written."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.id}_{name}")
        self._tables, self._paths = [], {}
        self.remove()

    def remove(self, name: str = "") -> None:
        """Delete one table's files, or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
