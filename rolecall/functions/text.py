"""Text, number and token rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s leaves out the four separator controls.
_SPACE = r"[\s\x1c-\x1f]"
# A run of white space that is not one plain space already: most words of a long text are left alone.
UNTIDY = rf"(?U){_SPACE}(?:(?<! ){_SPACE}*|{_SPACE}+)"
#: A character that squeezing leaves.
INKED = r"(?U)[^\s\x1c-\x1f]"

# Words that hint at a working mode, and accepted explicit spellings.
REMOTE_WORDS = ("remote", "work from home", "wfh", "anywhere")
HYBRID_WORDS = ("hybrid",)
REMOTE_SPELLINGS = {
    "remote": ("remote", "fully remote", "work from home", "wfh"),
    "hybrid": ("hybrid",),
    "onsite": ("onsite", "on-site", "in-office", "in office", "office"),
}
# Location parts that are not places.
NON_PLACES = ("remote", "hybrid", "onsite", "on-site", "anywhere", "worldwide", "virtual")

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Turn every whitespace run into one space and strip the ends."""
    return F.trim(F.regexp_replace(c, UNTIDY, " "))


def long_text(rule: Callable[[Column], Column], c: Column) -> Column:
    """``rule`` of a text that may be long, worked out by itself.

    A projection over many columns is generated as one method, and the JVM never compiles methods of more than 8,000
    bytes: loops over a text that are part of it would be interpreted. A lambda is not generated into that method.
    """
    return F.get(F.transform(F.array(c), rule), 0)


def once(rule: Callable[[Column], Column], c: Column) -> Column:
    """``rule`` of a value that it reads many times: branches of a condition would work ``c`` out again in each."""
    return F.get(F.transform(F.array(c), rule), 0)


def is_unspaced(word: str) -> bool:
    """Whether a text holds ``word`` before squeezing exactly when it does after."""
    return bool(word) and not any(ch.isspace() for ch in word)


def clean_text(c: Column) -> Column:
    """Squeezed text, null when nothing is left."""
    return blank_to_null(squeeze(c))


def to_int(c: Column) -> Column:
    """Read as a number and truncate toward zero; anything else is null."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")))
    return number.try_cast("double").try_cast("int")


def to_float(c: Column) -> Column:
    """Keep digits and points only (so the sign is lost), then read as a number."""
    return blank_to_null(F.regexp_replace(c.cast("string"), r"[^\d.]", "")).try_cast("double")


def token(c: Column) -> Column:
    """``Full-time`` becomes ``full_time``."""
    return blank_to_null(F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", "_"), F.lit("_")))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """True if ``text`` contains one of ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def hint_text(stated: Column, *texts: Column, folded: bool = False) -> Column:
    """Lower-case texts in one, for :func:`remote_status`; null where the stated mode settles it. ``folded`` says
    the texts are in lower case."""
    known = [s for spellings in REMOTE_SPELLINGS.values() for s in spellings]
    joined = F.concat_ws(" ", *[blank_to_null(t) for t in texts])
    return F.when(~F.coalesce(stated.isin(*known), F.lit(False)), joined if folded else F.lower(joined))


def remote_status(stated: Column, hints: Column) -> Column:
    """The stated (lower-case) working mode if it is a known spelling, else hints from texts."""
    result = None
    for mode, spellings in REMOTE_SPELLINGS.items():
        test = stated.isin(*spellings)
        result = F.when(test, mode) if result is None else result.when(test, mode)
    return (
        result.when(has_any(hints, HYBRID_WORDS), "hybrid")
        .when(has_any(hints, REMOTE_WORDS), "remote")
        .otherwise("unknown")
    )


def location_parts(location: Column, clean: bool = False) -> tuple[Column, Column]:
    """City and country of ``"City, …, Country"``; both null without a comma. ``clean`` says the text went
    through :func:`clean_text` before."""
    text = location if clean else clean_text(location)
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    usable = F.size(parts) >= 2

    def place(index: int) -> Column:
        part = F.try_element_at(parts, F.lit(index))
        return F.when(usable & ~F.lower(part).isin(*NON_PLACES), part)

    return place(1), place(-1)


def skill_list(c: Column, data_type: str) -> Column:
    """Skills as clean strings in their given order, blanks dropped, repeats kept.

    A text column may hold a JSON array or text split by comma, semicolon or pipe.
    """
    if data_type.startswith("array"):
        items = c
    else:
        items = F.when(
            F.ltrim(c).startswith("["), F.from_json(c, "array<string>")
        ).otherwise(F.split(c, r"[,;|]"))
    cleaned = F.transform(items, clean_text)
    return F.coalesce(F.filter(cleaned, lambda s: s.isNotNull()), F.array().cast("array<string>"))


def experience_label(low: Column, high: Column) -> Column:
    """``2-5 yrs``, ``3-? yrs`` or ``Not listed``."""
    side = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.when(low.isNull() & high.isNull(), "Not listed").otherwise(
        F.concat(side(low), F.lit("-"), side(high), F.lit(" yrs"))
    )
