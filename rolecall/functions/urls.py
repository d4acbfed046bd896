"""Canonical links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions.text import blank_to_null, clean_text

# Query parameters that only track where a visitor came from.
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ("gclid", "fbclid", "ref", "ref_src", "source", "trk", "mkt_tok")

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*$"


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    """Form encoding that leaves ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    """Parameters without tracking ones, decoded, sorted by name and value, encoded again."""

    def pair(item: Column) -> Column:
        name = F.substring_index(item, "=", 1)
        value = F.substr(item, F.length(name) + F.lit(2))
        return F.struct(_decode(name).alias("k"), _decode(value).alias("v"))

    def wanted(p: Column) -> Column:
        name = F.lower(p["k"])
        return ~name.startswith(TRACKING_PREFIX) & ~name.isin(*TRACKING_NAMES)

    items = F.filter(F.split(query, "&"), lambda item: item != "")
    pairs = F.array_sort(F.filter(F.transform(items, pair), wanted))
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def canonical_url(c: Column, clean: bool = False) -> Column:
    """Form used to compare links.

    Lower-case scheme and host, no default port, fragment, tracking parameter or trailing
    slash, sorted parameters. Text without scheme or host only loses trailing slashes.
    ``clean`` says the text went through :func:`clean_text` before.
    """
    text = c if clean else clean_text(c)
    no_fragment = F.substring_index(text, "#", 1)
    before_query = F.substring_index(no_fragment, "?", 1)
    query = F.substr(no_fragment, F.length(before_query) + F.lit(2))
    scheme = F.substring_index(before_query, "://", 1)
    rest = F.substr(before_query, F.length(scheme) + F.lit(4))
    netloc = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(netloc) + F.lit(1))

    scheme_l = F.lower(scheme)
    host = F.lower(netloc)
    host = (
        F.when((scheme_l == "http") & host.endswith(":80"), F.substr(host, F.lit(1), F.length(host) - F.lit(3)))
        .when((scheme_l == "https") & host.endswith(":443"), F.substr(host, F.lit(1), F.length(host) - F.lit(4)))
        .otherwise(host)
    )
    short_path = F.when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise("/")
    params = F.when(query == "", "").otherwise(_clean_query(query))
    full = F.concat(
        scheme_l, F.lit("://"), host, short_path,
        F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)),
    )
    absolute = scheme.rlike(_SCHEME) & (netloc != "")
    return F.when(absolute, full).otherwise(F.rtrim(text, F.lit("/")))


def url_host(url: Column) -> Column:
    """Host part of a link as written, null without one."""
    return blank_to_null(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def domain_key(c: Column) -> Column:
    """Bare domain of ``https://www.Example.com/path``; null when nothing is left."""
    text = F.lower(F.trim(c))
    bare = F.regexp_replace(text, r"^(http://)?(https://)?(www\.)?", "")
    return blank_to_null(F.trim(F.substring_index(bare, "/", 1)))
