"""Keys that tell records and entities apart, and what a source is worth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions.text import squeeze

# Legal and country words that do not tell companies apart.
NAME_NOISE = (
    "pvt", "private", "limited", "ltd", "inc", "llc", "llp", "corp", "corporation", "co",
    "company", "gmbh", "ag", "sa", "bv", "nv", "plc", "group", "india",
)
# Source keys per kind; lower tier means closer to the employer.
COMPANY_PAGES = ("company_careers", "generic")
HIRING_SYSTEMS = (
    "greenhouse", "lever", "workday", "ashby", "smartrecruiters", "icims", "taleo", "jobvite",
    "bamboohr", "recruitee", "teamtailor", "successfactors",
)
BOARDS = ("indeed", "hirist", "naukri", "linkedin")
TEST_SOURCES = ("fixture", "fixture_web")


def entity_key(name: Column) -> Column:
    """Lower-case name without punctuation and legal words, ``""`` for none."""
    words = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")
    kept = F.regexp_replace(words, r"\b(" + "|".join(NAME_NOISE) + r")\b", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def identity_hash(company: Column, title: Column, location: Column, low: Column, high: Column) -> Column:
    """SHA-256 over name key, title, location and range: one value per posting anywhere."""
    fold = lambda c: squeeze(F.lower(F.coalesce(c, F.lit(""))))
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(
        F.concat_ws("|", entity_key(company), fold(title), fold(location), number(low), number(high)), 256
    )


def payload_hash(columns: list[str]) -> Column:
    """SHA-256 of the named columns, independent of their order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def nested_hash(payload: Column) -> Column:
    """SHA-256 of a JSON text that does not depend on white space or on the order of keys, at any depth.

    A VARIANT keeps the keys of every object sorted, so its JSON is canonical. Text that is no JSON is hashed as it is.
    """
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(payload)), payload), 256)


def map_hash(payload: Column) -> Column:
    """SHA-256 of a map, independent of its key order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(payload)))
    return F.sha2(F.to_json(ordered), 256)


def source_tier(source: Column) -> Column:
    """1 company page, 2 hiring system, 3 anything else."""
    key = F.lower(F.coalesce(source, F.lit("")))
    return F.when(key.isin(*COMPANY_PAGES), 1).when(key.isin(*HIRING_SYSTEMS), 2).otherwise(3)


def source_type(source: Column) -> Column:
    key = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(key.isin(*COMPANY_PAGES), "company_careers")
        .when(key.isin(*HIRING_SYSTEMS), "ats")
        .when(key.isin(*BOARDS), "job_board")
        .otherwise("other")
    )


def scatter_nulls(key: Column, spread_by: Column, ways: int = 4096) -> Column:
    """A join key whose nulls are spread over many values that match nothing.

    Null keys of an outer join would otherwise all meet in one shuffle partition.
    """
    filler = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread_by), F.lit(ways)).cast("string"))
    return F.coalesce(key, filler)
