"""Look-ups of entities, best links and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.identity import entity_key, scatter_nulls, source_tier
from rolecall.functions.text import blank_to_null
from rolecall.functions.urls import domain_key, url_host


def first_entity_per(entities: DataFrame, key: Column) -> DataFrame:
    """``(key, entity)``: the first entity by priority, then name, for each key."""
    entity = F.struct("priority", "name", "entity_id")
    return (
        entities.select(key.alias("key"), entity.alias("entity"))
        .where(blank_to_null(F.col("key")).isNotNull())
        .groupBy("key")
        .agg(F.min("entity").alias("entity"))
    )


def attach_context(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Give rows of company-by-company sources the entity they were fetched for."""
    hint = F.coalesce(blank_to_null(F.col("company_hint")), F.col("company_name"))
    key = F.when(F.col("mode") == "company", blank_to_null(entity_key(hint)))
    by_name = first_entity_per(entities, entity_key(F.col("name")))
    return (
        raw.withColumn("key", scatter_nulls(key, F.col("seq")))
        .join(by_name, "key", "left")
        .withColumns({"context_name": F.col("entity.name"), "context_id": F.col("entity.entity_id")})
        .drop("key", "entity")
    )


def match_entities(postings: DataFrame, entities: DataFrame, spread_by: str = "seq") -> DataFrame:
    """Exact match by name key, then by domain; disabled entities match as well.

    A context entity, when present, is final. Both build sides hold one small row per key;
    the planner broadcasts them only while their measured size is under its threshold.
    """
    has_context = "context_id" in postings.columns
    context_id = F.col("context_id") if has_context else F.lit(None).cast("long")
    context_name = F.col("context_name") if has_context else F.lit(None).cast("string")
    by_name = first_entity_per(entities, entity_key(F.col("name"))).select(
        F.col("key").alias("_name"), F.col("entity").alias("_by_name")
    )
    by_domain = first_entity_per(entities, domain_key(F.col("domain"))).select(
        F.col("key").alias("_domain"), F.col("entity").alias("_by_domain")
    )
    name = F.when(context_name.isNull(), blank_to_null(entity_key(F.col("company_name"))))
    link = F.coalesce(blank_to_null(F.col("source_url")), F.col("canonical_url"))
    stated = domain_key(F.col("company_domain")) if "company_domain" in postings.columns else F.lit(None)
    domain = F.when(
        context_name.isNull() & F.col("_by_name").isNull(), F.coalesce(stated, domain_key(url_host(link)))
    )
    spread = F.col(spread_by)
    hit = F.coalesce("_by_name", "_by_domain")
    return (
        postings.withColumn("_name", scatter_nulls(name, spread))
        .join(by_name, "_name", "left")
        .withColumn("_domain", scatter_nulls(domain, spread))
        .join(by_domain, "_domain", "left")
        .withColumns(
            {
                "target_match": F.coalesce(context_name, hit["name"]),
                "entity_id": F.coalesce(context_id, hit["entity_id"]),
            }
        )
        .withColumn("match_confidence", F.when(F.col("target_match").isNotNull(), "HIGH").otherwise("NONE"))
        .drop("_name", "_domain", "_by_name", "_by_domain")
    )


def best_links(postings: DataFrame, refs: DataFrame) -> DataFrame:
    """``(job_id, application_url)``: lowest tier, own link first, then reference order.

    ``postings`` gives job_id, source, source_url and canonical_url; ``refs`` gives job_id,
    source, source_url and ref_id. A record without any link falls back to its canonical one.
    """
    own = postings.select("job_id", "source", "source_url", F.lit(-1).cast("long").alias("rank"))
    others = refs.select("job_id", "source", "source_url", F.col("ref_id").alias("rank"))
    best = (
        own.unionByName(others)
        .where(blank_to_null(F.col("source_url")).isNotNull())
        .groupBy("job_id")
        .agg(F.min_by("source_url", F.struct(source_tier(F.col("source")), "rank")).alias("best"))
    )
    return postings.join(best, "job_id", "left").select(
        "job_id", F.coalesce("best", "canonical_url").alias("application_url")
    )


def with_priority(postings: DataFrame, entities: DataFrame, default: str = "C") -> DataFrame:
    """Add ``priority`` by exact company name, ``default`` where the name is unknown."""
    lookup = entities.groupBy(F.col("name").alias("company_name")).agg(F.min("priority").alias("_priority"))
    return (
        postings.join(lookup, "company_name", "left")
        .withColumn("priority", F.coalesce("_priority", F.lit(default)))
        .drop("_priority")
    )
