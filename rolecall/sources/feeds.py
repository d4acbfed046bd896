"""Readers that bring files into the raw layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.dates import epoch_text
from rolecall.functions.text import blank_to_null
from rolecall.schemas import PAYLOAD, PAYLOAD_FIELDS, RAW

REQUIRED_ENTITY_COLUMNS = ("company_name", "company_domain", "careers_url", "priority", "enabled")
TRUE_WORDS = ("1", "true", "yes", "y")
BLOCK_BITS = 20

BROKEN = "_broken"
DATE_FIELDS = ("posted_date", "updated_date")
_ENTRY = T.StructType([T.StructField("source", T.StringType()), *PAYLOAD.fields])


def read_nested_json(spark: SparkSession, path: str, default_source: str = "fixture") -> DataFrame:
    """Documents of the form ``{"jobs": [...]}``, one row per element, in element order.

    A document is one JSON value and so one task's work; large feeds belong in JSON lines
    (:func:`read_json_lines`), which split.
    """
    layout = T.StructType([T.StructField("jobs", T.ArrayType(_ENTRY))])
    docs = spark.read.schema(layout).json(path, multiLine=True, mode="FAILFAST")
    return nested_entries(docs, F.col("jobs"), default_source)


def nested_entries(docs: DataFrame, entries: Column, default_source: str) -> DataFrame:
    """Explode an array of payload structs into raw rows, keeping arrival order.

    The number follows (task, row): documents in file order, elements in their own order.
    """
    flat = explode_entries(docs, entries)
    return to_raw(flat.withColumn("seq", F.monotonically_increasing_id()), default_source)


def explode_entries(docs: DataFrame, entries: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per array element: ``keep`` columns, ``pos`` in the array, then its fields."""
    return docs.select(*keep, F.posexplode(entries).alias("pos", "e")).select(*keep, "pos", "e.*")


def read_json_lines(spark: SparkSession, path: str, default_source: str = "fixture") -> DataFrame:
    """One payload per line; read in parallel splits, ordered by (split, line). Broken lines are
    left out; :func:`read_json_lines_checked` also returns them."""
    return read_json_lines_checked(spark, path, default_source)[0]


def read_json_lines_checked(spark: SparkSession, path: str, default_source: str = "fixture") -> tuple[DataFrame, DataFrame]:
    """(raw rows, broken lines as (seq, line)). A date given as a number is epoch seconds."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    return quarantine_split(lines, "value", default_source)


def quarantine_split(lines: DataFrame, line: str, default_source: str = "fixture") -> tuple[DataFrame, DataFrame]:
    """(raw rows, broken lines) of payload text in a column; ``seq`` is kept."""
    kinds = [T.StructField(f.name, T.VariantType() if f.name in DATE_FIELDS else f.dataType) for f in _ENTRY.fields]
    layout = T.StructType([*kinds, T.StructField(BROKEN, T.StringType())])
    payload = F.from_json(F.col(line), layout, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    read = lines.select("seq", payload.alias("p"), F.col(line).alias("line"))
    bad = F.col("p").isNull() | F.col(f"p.{BROKEN}").isNotNull()
    good = read.where(~bad).select("seq", "p.*").drop(BROKEN).withColumns({f: _date_text(F.col(f)) for f in DATE_FIELDS})
    return to_raw(good, default_source), read.where(bad).select("seq", "line")


def broken_rows(broken: DataFrame, source: str) -> DataFrame:
    """Error rows of broken lines, one each; the whole line is kept."""
    return broken.select("seq", F.lit(source).alias("source"), F.lit("INGEST").alias("error_type"), F.concat(F.lit("unreadable record: "), "line").alias("message"))


def _date_text(value: Column) -> Column:
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(number, epoch_text(F.try_variant_get(value, "$", "double"))).otherwise(F.try_variant_get(value, "$", "string"))


def to_raw(rows: DataFrame, default_source: str, mode: str = "board") -> DataFrame:
    """Fill up the raw layout: default source, link and hint from the payload."""
    have = set(rows.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return rows.select(
        F.col("seq"),
        F.coalesce(get("source"), F.lit(default_source)).alias("source"),
        F.coalesce(get("mode"), F.lit(mode)).alias("mode"),
        F.coalesce(get("source_url"), get("url")).alias("source_url"),
        F.coalesce(get("company_hint"), get("company_name")).alias("company_hint"),
        *[get(c).alias(c) for c in PAYLOAD_FIELDS],
    ).to(RAW)


def narrow(raw: DataFrame, company: str | None = None, limit: int | None = None) -> DataFrame:
    """Ask a source for companies containing a text and for the first rows only (0: all)."""
    out = raw
    if company:
        out = out.where(F.contains(F.lower(F.coalesce("company_name", F.lit(""))), F.lit(company.lower())))
    if limit:
        out = out.orderBy("seq").limit(int(limit))
    return out


def read_entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Target list from CSV: ``(good, rejected)``. Rows without a name are rejected."""
    table = spark.read.csv(path, header=True, inferSchema=False)
    table = table.toDF(*[c.strip().lower() for c in table.columns])
    missing = sorted(set(REQUIRED_ENTITY_COLUMNS) - set(table.columns))
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return entity_rows(table)


def entity_rows(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean a text table with the required entity columns: ``(good, rejected)``."""
    value = lambda c: blank_to_null(F.trim(F.col(c)))
    rows = table.select(
        value("company_name").alias("name"),
        value("company_domain").alias("domain"),
        value("careers_url").alias("careers_url"),
        F.upper(F.coalesce(value("priority"), F.lit("B"))).alias("priority"),
        F.coalesce(F.lower(value("enabled")).isin(*TRUE_WORDS), F.lit(False)).alias("enabled"),
        F.lit(None).cast("string").alias("ats"),
        F.monotonically_increasing_id().alias("position"),
    )
    return rows.where(F.col("name").isNotNull()), rows.where(F.col("name").isNull())


def select_entities(entities: DataFrame, company: str | None = None, limit: int | None = None) -> DataFrame:
    """Enabled entities whose name contains a text, the first ``limit`` in list order (0: all).

    ``position`` gives the list order where present; otherwise priority and name do.
    """
    out = entities.where("enabled")
    if company:
        out = out.where(F.contains(F.lower("name"), F.lit(company.lower())))
    if limit:
        order = ["position"] if "position" in entities.columns else ["priority", "name"]
        out = out.orderBy(*order).limit(max(0, int(limit)))
    return out


def combine(parts: list[DataFrame]) -> DataFrame:
    """All sources in one layout; arrival order is (place of the source, its own order).

    Each source's numbers start at the first block of 2^20 behind the source before it, so no two
    sources share a number, however many tasks read them.
    """
    out, start = None, 0
    for part in parts:
        rows = part.withColumn("seq", F.col("seq") + F.lit(start << BLOCK_BITS))
        last = part.agg(F.max("seq")).first()[0]  # one number
        start += 0 if last is None else (last >> BLOCK_BITS) + 1
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources to combine")
    return out
