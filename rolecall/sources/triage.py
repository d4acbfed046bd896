"""What to do with a fetch: review queues and outcomes of a crawl log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text that shows a page asks for a person.
CHALLENGE_MARKERS = (
    "captcha", "are you a robot", "unusual traffic", "verify you are human", "cloudflare ray id",
    "attention required",
)
BLOCKED_CODES = (401, 403, 429, 503)

NO_PAGE_REASON = "No careers page is known for this entity and none is looked up automatically."
NO_PAGE_ACTION = "Add the careers page to the entity list, or check the entity's website by hand."
PAGE_REASON = "Careers pages of this kind are not read automatically; no request was made."


def review_queue(entities: DataFrame, source: str = "generic", seq: Column | None = None) -> DataFrame:
    """One MANUAL_REVIEW row per entity, saying why and what a person should do."""
    known = F.coalesce(F.col("careers_url"), F.lit("")) != ""
    return entities.select(
        (F.monotonically_increasing_id() if seq is None else seq).alias("seq"),
        F.lit(source).alias("source"),
        F.lit("MANUAL_REVIEW").alias("status"),
        F.col("name").alias("company"),
        F.when(known, F.col("careers_url")).alias("url"),
        F.when(known, PAGE_REASON).otherwise(NO_PAGE_REASON).alias("reason"),
        F.when(
            known, F.concat(F.lit("Open "), F.col("careers_url"), F.lit(" in a browser and review it by hand."))
        ).otherwise(NO_PAGE_ACTION).alias("action"),
        F.lit(0).cast("long").alias("n_jobs"),
    )


def triage(log: DataFrame, max_retries: int = 2, window: int | None = None) -> DataFrame:
    """Add ``outcome`` and ``outcome_reason`` to fetch responses (status, body, attempt).

    ``attempt`` counts from 0. Blocked and challenged responses go to a person and are never
    retried; server errors are retried until the attempts are used up. ``window`` limits the search
    for challenges to the first characters of a body; by default all of it is searched.
    """
    status = F.col("status")
    body = F.coalesce("body", F.lit(""))
    head = F.lower(body if window is None else F.substring(body, 1, window))
    challenged = (status >= 400) & head.rlike("|".join(CHALLENGE_MARKERS))
    server = status.between(500, 599)
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    cases = [
        (status == 200, "OK", F.lit(None).cast("string")),
        (
            status.isin(*BLOCKED_CODES) | challenged,
            "MANUAL_REVIEW",
            F.concat(code, F.lit(" - access blocked or rate limited; not retried")),
        ),
        (status == 404, "FAILED", F.concat(code, F.lit(" - page not found"))),
        (server & (F.col("attempt") < max_retries), "RETRY", F.concat(code, F.lit(" - server error"))),
        (
            server,
            "FAILED",
            F.concat(code, F.lit(" - server error after "), (F.col("attempt") + 1).cast("string"), F.lit(" attempts")),
        ),
    ]
    outcome, reason = None, None
    for test, label, why in cases:
        outcome = F.when(test, label) if outcome is None else outcome.when(test, label)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return log.withColumns(
        {
            "outcome": outcome.otherwise("FAILED"),
            "outcome_reason": reason.otherwise(F.concat(code, F.lit(" - unexpected response"))),
        }
    )
