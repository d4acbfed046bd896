"""The corpus pipeline: documents in, a mixed training order out.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the one before kept.
Stages are written as Parquet and read again between calls. All but the last return the columns
of ``documents``; the last adds the place of each document in the mixture. What a stage staged for itself is
dropped when the next one over the same tables begins: by then its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import decontaminate, jaccard, line_dedup, mixing, toxicity
from rolecall.llm.storage import Staging

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # a fitted classifier decides in the first stage
_LEFT: dict[str, Staging] = {}


def _begin(spark: SparkSession, sf_dir: str, name: str) -> Staging:
    """A folder for a stage's own tables; that of the stage before goes."""
    if sf_dir in _LEFT:
        _LEFT.pop(sf_dir).close()
    return _LEFT.setdefault(sf_dir, Staging(spark, f"pipeline_{name}"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Learned from labels that are not held out. Documents
    with a null or empty text have the score of no evidence and stay."""
    _begin(spark, sf_dir, "toxicity")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_model(docs, labels, ~toxicity.held_out("doc_id"))
    return docs.where(toxicity.toxicity("text", model) < toxicity.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; documents stay, ``n_chars`` follows. Null texts stay
    null, rows without id keep their lines."""
    done = line_dedup.drop_repeated_lines(docs.select(*COLUMNS), _begin(spark, sf_dir, "lines"))
    return done.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of a similarity of 0.8 or more, the one with the
    smallest id stays, once: of rows that share an id, the one with the smallest text (then lang, source,
    n_chars). A row without id is not judged; texts without words are linked with nothing and stay."""
    docs = docs.select(*COLUMNS)
    found = jaccard.component_ids(docs, _begin(spark, sf_dir, "groups"), n=5, num=80)
    first = found.where(F.col("_id") == F.col("component_id")).select(F.col("_id").alias("doc_id")).distinct()
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_row"))
    kept = kept.select("doc_id", "_row.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which at least half of a benchmark item, or 13 words of it in a row, are found go. Null and
    empty texts hold no item; rows without id stay."""
    _begin(spark, sf_dir, "leaks")
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), veto=False).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its source's block and the block's place in the mixture; sources are
    weighed by the square root of their size. Null texts have length 0, a null source counts as ''."""
    _begin(spark, sf_dir, "mixture")
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS, "mix_block", "mix_at", "mix_slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    staging = Staging(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staging.write(stage(spark, docs, sf_dir), name)
        if before:
            staging.drop(before)  # read by the stage just written alone
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
