"""Tolerant date reading. Nothing is guessed: unreadable text gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.text import clean_text

# Accepted non-ISO layouts, tried in this order, with the shape each one needs.
# The shape test is cheap and keeps hopeless text away from the parsers.
LAYOUTS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("MMM d yyyy", r"^[A-Za-z]{3} \d{1,2} \d{4}$"),
    ("MMMM d yyyy", r"^[A-Za-z]+ \d{1,2} \d{4}$"),
)

# date, optional one-character separator and time, optional fraction, optional offset
_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
_NAIVE = "yyyy-MM-dd'T'HH:mm:ss"


def with_dates(df: DataFrame, columns: dict[str, Column], instants: dict[str, str] | None = None) -> DataFrame:
    """Add each column read as canonical ISO text, and ``instants`` (name: text column).

    Text is read as ISO or one of the other layouts; eight digits are a calendar date and other
    digits are no date. Only a numeric column is epoch seconds in UTC. The steps are separate
    columns so that each is worked out once per row.
    """
    kinds = df.select(*[c.alias(n) for n, c in columns.items()]).schema
    numbers = {n: c for n, c in columns.items() if isinstance(kinds[n].dataType, T.NumericType)}
    df = df.withColumns({n: epoch_text(c) for n, c in numbers.items()})
    columns = {n: F.col(n) if n in numbers else c for n, c in columns.items()}
    text = {n: F.col(f"_{n}_text") for n in columns}
    parts = {n: F.col(f"_{n}_parts") for n in columns}
    iso = {n: F.col(f"_{n}_iso") for n in columns}
    helpers = [f"_{n}_{step}" for n in columns for step in ("text", "parts", "iso")]
    out = (
        df.withColumns({f"_{n}_text": clean_text(c.cast("string")) for n, c in columns.items()})
        .withColumns({f"_{n}_parts": _iso_parts(text[n]) for n in columns})
        .withColumns({f"_{n}_iso": _iso_text(parts[n]) for n in columns})
        .withColumns({n: _best_text(text[n], iso[n]) for n in columns})
        .drop(*helpers)
    )
    return out.withColumns({name: iso_instant(F.col(n)) for name, n in (instants or {}).items()})


def _iso_parts(text: Column) -> Column:
    split = F.split(F.regexp_replace(text, _ISO, "$1|$3|$4|$5|$6|$7|$8|$9"), r"\|")
    return F.when(text.rlike(_ISO), split)


def _iso_text(parts: Column) -> Column:
    """Canonical text from the parts of ISO input (ranges are checked by the caller)."""
    two = lambda i: F.when(parts[i] == "", "00").otherwise(parts[i])
    micros = F.rpad(F.substring(parts[6], 1, 6), 6, "0")
    zone = F.regexp_replace(F.replace(parts[7], F.lit("Z"), F.lit("+00:00")), r"^(...)(\d\d)$", "$1:$2")
    return F.concat(
        parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit("T"),
        two(3), F.lit(":"), two(4), F.lit(":"), two(5),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        zone,
    )


def _best_text(text: Column, iso: Column) -> Column:
    other = F.coalesce(
        *[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))) for layout, shape in LAYOUTS]
    )
    return F.coalesce(
        F.when(iso_instant(iso).isNotNull(), iso),
        F.date_format(other, _NAIVE),
    )


def epoch_text(seconds: Column) -> Column:
    """Canonical text of epoch seconds in UTC; null outside the years 1 to 9999."""
    at = F.timestamp_micros((seconds.cast("double") * 1000000).try_cast("long"))
    micros = F.date_format(at, "SSSSSS")
    text = F.concat(F.date_format(at, _NAIVE), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
    return F.when(F.year(at).between(1, 9999), text)


def iso_instant(iso: Column) -> Column:
    """Timestamp of canonical ISO text; text without an offset counts as UTC."""
    zoned = F.when(iso.rlike(r"[+-]\d\d:\d\d$"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    layout = F.when(F.contains(iso, F.lit(".")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").otherwise(
        "yyyy-MM-dd'T'HH:mm:ssXXX"
    )
    return F.try_to_timestamp(zoned, layout)
