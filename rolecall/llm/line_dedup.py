r"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending id. A run is a table of (line hash, owner), hash-bucketed
and sorted, one row per distinct line; the owner is the smallest id that holds the line. A new
batch is reduced to its distinct lines (combined on the map side, so a line that a third of the
documents hold is one row per task), merge-joined with the runs bucket by bucket, and the lines
that no run holds become a new run of level 0. When a level has ``fanout`` runs they are merged
into one of the next level. A line is dropped from every document that is not its owner.

Only hashes and ids are staged and moved; texts are shuffled once, when the result is built.
Line keys are 128 bits wide (two independent 64-bit hashes).

Defined cases: a null or empty text is one empty line, and kept as it is; a line is judged by its
key (``[\x20\x09-\x0D]`` stripped at both ends, A-Z lower-cased) when the key has at least
``min_chars`` code points; repeated lines inside the owner all stay; rows with one id are one
document and lose the same lines; a row without id neither drops nor owns lines. Other columns
pass through; ``n_lines``, ``n_dropped`` and the text column are replaced where they exist.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.storage import Staging

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
_SEED = 42  # the seed of Spark's xxhash64
_KEY = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


class LineRuns:
    """The runs: an index of the lines seen so far that grows batch by batch."""

    def __init__(self, staging: Staging, buckets: int, fanout: int = 2) -> None:
        self.staging, self.buckets, self.fanout = staging, buckets, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self._n = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        name = f"run{self._n}_{uuid.uuid4().hex[:6]}"
        self._n += 1
        return name, self.staging.write_sorted(df.select(*_KEY, "owner"), name, _KEY, self.buckets)

    def absorb(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (_id, _h1, _h2); returns (_id, _h1) of the lines that go."""
        own = lines.groupBy(*_KEY).agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
        looked = own
        for i, run in enumerate(self.runs()):
            looked = looked.join(run.withColumnRenamed("owner", f"_o{i}"), _KEY, "left")
        known = F.coalesce(*[F.col(f"_o{i}") for i in range(len(self.runs()))], F.lit(None).cast("long"))
        looked = looked.select(*_KEY, "first", "last", known.alias("known"))
        looked = self.staging.write(looked, f"batch{self._n}")
        shared = looked.where(F.col("known").isNotNull() | (F.col("first") < F.col("last")))
        shared = shared.select(*_KEY, F.coalesce("known", "first").alias("owner"))
        gone = lines.join(shared, _KEY).where(F.col("owner") != F.col("_id")).select("_id", "_h1")
        gone = self.staging.write(gone, f"gone{self._n}")
        self.levels[0].append(self._write(looked.where("known IS NULL").select(*_KEY, F.col("first").alias("owner"))))
        self._compact()
        return gone

    def _compact(self) -> None:
        for at, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            if at + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(DataFrame.unionByName, [run for _, run in level])  # keys of runs are disjoint
            self.levels[at + 1].append(self._write(merged.repartition(self.buckets, *_KEY)))
            for name, _ in level:
                self.staging.forget(name)
            self.levels[at] = []


def _strip(text: str, gone: set[int], min_chars: int) -> tuple[str, int]:
    kept, dropped = [], 0
    for line in text.split("\n"):
        key = line.strip(BLANK).translate(_FOLD)
        if len(key) >= min_chars and xxhash.xxh64_intdigest(key.encode(), _SEED) in gone:
            dropped += 1
        else:
            kept.append(line)
    return "\n".join(kept), dropped


def drop_repeated_lines(docs: DataFrame, staging: Staging, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and ``n_lines`` (before), ``n_dropped``."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] if batches > 1 else []
    batch = sum((F.when(F.col("_id") >= c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    line = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.split(F.col(text), "\n"))).alias("_line"))
    line = line.select("_id", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    line = line.select("_id", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")).withColumn("_batch", batch)
    line = staging.write(line, "lines", by="_batch")
    runs = LineRuns(staging, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    gone = [runs.absorb(line.where(F.col("_batch") == b).drop("_batch")) for b in range(len(set(cuts or [])) + 1)]
    lists = reduce(DataFrame.unionByName, gone).groupBy("_id").agg(F.collect_set("_h1").alias("_gone"))

    @F.arrow_udf("struct<kept:string,dropped:long>")
    def strip(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in parts:
            done = [_strip(t.as_py(), {h & 0xFFFFFFFFFFFFFFFF for h in g.as_py()}, min_chars) if g.is_valid else None for t, g in zip(texts, gone, strict=True)]
            yield pa.array([d and {"kept": d[0], "dropped": d[1]} for d in done], pa.struct([("kept", pa.string()), ("dropped", pa.int64())]))

    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    body = F.col(f"d.{text}")
    out = docs.select(*columns).alias("d").join(lists.alias("g"), F.col(f"d.{id_col}") == F.col("g._id"), "left")
    out = out.select(*[F.col(f"d.{c}").alias(c) for c in columns], F.col("g._gone").alias("_gone"), strip(F.when(F.col("g._gone").isNotNull(), body), F.col("g._gone")).alias("_done"))
    return out.select(
        *[F.coalesce("_done.kept", text).alias(c) if c == text else c for c in columns],
        F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("_done.dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
