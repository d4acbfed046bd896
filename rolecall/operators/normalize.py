"""The normalisation job: raw payload rows to one fixed posting layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import dates, identity, text, urls
from rolecall.schemas import PAYLOAD_FIELDS

#: Columns a raw table may carry besides the payload.
CARRIED = ("seq", "source", "mode", "source_url", "company_hint", "context_name", "context_id")


def normalize_postings(raw: DataFrame) -> DataFrame:
    """Clean every payload column in one pass; missing columns count as null.

    ``context_name`` (the entity a company-by-company source was asked about) fills in for a
    missing company name. Nothing is invented: what cannot be read stays null.

    ``search_text`` is the description in lower case before white space is squeezed: hints and words without
    white space are looked for there, so that searches need no squeezed text. It is not part of a record; drop it
    before rows are stored.
    """
    types = dict(raw.dtypes)

    def given(name: str) -> Column:
        return F.col(name) if name in types else F.lit(None).cast("string")

    clean = {name: text.clean_text(given(name)) for name in (
        "title", "company_name", "location", "city", "country", "source_job_id",
        "department", "salary_currency", "ats",
    )}
    clean["description"] = text.blank_to_null(F.col("_body"))
    payload = [c for c in (*PAYLOAD_FIELDS,) if c in types]
    stated = F.lower(text.clean_text(given("remote_status")))
    body = text.long_text(text.squeeze, given("description").cast("string"))
    low = F.lower(given("description").cast("string"))
    base = raw.withColumns({"_body": body, "search_text": low}).select(
        *[given(name).alias(name) for name in CARRIED if name not in ("source_url",)],
        given("company_domain").alias("company_domain"),
        F.coalesce(text.clean_text(given("source_url")), text.clean_text(given("url"))).alias("source_url"),
        *[clean[n].alias(n) for n in clean if n not in ("title", "company_name")],
        F.coalesce(clean["title"], F.lit("")).alias("title"),
        F.coalesce(
            clean["company_name"], given("context_name"), text.clean_text(given("company_hint")), F.lit("")
        ).alias("company_name"),
        stated.alias("_stated"),
        text.hint_text(stated, F.lower(clean["location"]), F.col("search_text"), F.lower(given("title")), folded=True).alias("_hints"),
        "search_text",
        text.token(given("employment_type")).alias("employment_type"),
        text.to_int(given("experience_min")).alias("_low"),
        text.to_int(given("experience_max")).alias("_high"),
        text.skill_list(given("skills"), types.get("skills", "string")).alias("skills"),
        text.to_float(given("salary_min")).alias("salary_min"),
        text.to_float(given("salary_max")).alias("salary_max"),
        given("posted_date").alias("posted_date"),
        given("updated_date").alias("updated_date"),
        identity.payload_hash(payload).alias("raw_hash"),
        (
            given("source").isin(*identity.TEST_SOURCES)
            | ~F.lower(F.coalesce(given("_fixture"), F.lit("false"))).isin("", "false", "0")
        ).alias("is_fixture"),
    )
    both = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    derived_city, derived_country = text.location_parts(F.col("location"), clean=True)
    out = base.withColumns(
        {
            "experience_min": F.when(both, F.least("_low", "_high")).otherwise(F.col("_low")),
            "experience_max": F.when(both, F.greatest("_low", "_high")).otherwise(F.col("_high")),
            "city": F.coalesce("city", derived_city),
            "country": F.coalesce("country", derived_country),
            "canonical_url": urls.canonical_url(F.col("source_url"), clean=True),
            "remote_status": text.remote_status(F.col("_stated"), F.col("_hints")),
        }
    ).drop("_low", "_high", "_stated", "_hints")
    dated = dates.with_dates(
        out, {n: F.col(n) for n in ("posted_date", "updated_date")}, {"posted_at": "posted_date"}
    )
    return with_identity(dated)


def with_identity(postings: DataFrame) -> DataFrame:
    """Add the cross-source identity hash and the print of the content compared for change."""
    return postings.withColumns(
        {
            "content_hash": identity.identity_hash(
                F.col("company_name"), F.col("title"), F.col("location"),
                F.col("experience_min"), F.col("experience_max"),
            ),
            "content_print": content_print(F.col("posted_date"), F.col("description"), F.col("skills")),
        }
    )


def content_print(posted: Column, description: Column, skills: Column) -> Column:
    """Digest of the fields whose change counts as an update; null and empty stay apart."""
    return F.sha2(
        F.to_json(
            F.struct(posted.alias("p"), description.alias("d"), skills.alias("s")),
            {"ignoreNullFields": "false"},
        ),
        256,
    )
