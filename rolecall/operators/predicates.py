"""Match levels and the ordered filter.

Wanted values are driver-side settings, so each test unrolls into a chain of native
conditions instead of a lookup per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.config import SearchConfig
from rolecall.functions.text import INKED, blank_to_null, experience_label, is_unspaced, once
from rolecall.session import stage

FULL, PARTIAL, NONE, UNKNOWN = "FULL", "PARTIAL", "NONE", "UNKNOWN"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _first(*options: Column) -> Column:
    """First non-null option; null without options."""
    return F.coalesce(*options) if options else _null()


def texts(*options: Column) -> Column:
    """Array of the non-null options."""
    if not options:
        return F.array().cast("array<string>")
    return F.filter(F.array(*options), lambda t: t.isNotNull())


def folded(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def title_level(title: Column, roles: tuple[str, ...]) -> tuple[Column, Column]:
    """Level and role of a title.

    FULL: the first role phrase found inside the title. PARTIAL: the last role with at least
    half of its words in the title. Without roles everything is FULL, with no role.
    """
    if not roles:
        return F.lit(FULL), _null()
    low = folded(title)
    named = [role for role in roles if role]
    full = _first(*[F.when(F.contains(low, F.lit(r.lower())), r) for r in named])

    def half(role: str, words: Column) -> Column | None:
        tokens = sorted(set(re.findall(r"\w+", role.lower())))
        if not tokens:
            return None
        hits = sum((F.array_contains(words, t).cast("int") for t in tokens), F.lit(0))
        return F.when(hits * 2 >= len(tokens), role)

    def last_half(words: Column) -> Column:
        return _first(*[h for h in (half(r, words) for r in reversed(named)) if h is not None])

    partial = once(last_half, F.regexp_extract_all(low, F.lit(r"(?U)(\w+)")))
    level = (
        F.when(low == "", UNKNOWN)
        .when(full.isNotNull(), FULL)
        .when(partial.isNotNull(), PARTIAL)
        .otherwise(NONE)
    )
    return level, F.when(low != "", F.coalesce(full, partial))


def wanted_places(cfg: SearchConfig) -> set[str]:
    """Lower-cased names that stand for a wanted location."""
    named = {place.lower() for place in cfg.locations}
    return named.union(*[map(str.lower, other) for place, other in cfg.location_aliases.items() if place.lower() in named])


def location_variants(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(position, name) of wanted locations (position, location), each followed by its aliases
    (location, alias, place): lower-cased, each name once, at its first place."""
    own = wanted.select("position", F.lit(-1).cast("long").alias("place"), F.lower("location").alias("name"))
    other = aliases.select(F.lower("location").alias("name"), "place", F.lower("alias").alias("alias"))
    other = own.select("position", "name").join(other, "name").select("position", "place", F.col("alias").alias("name"))
    first = own.unionByName(other).groupBy("name").agg(F.min(F.struct("position", "place")).alias("at"))
    return first.select("at.position", "at.place", "name")


def location_level(location: Column, city: Column, country: Column, remote: Column, cfg: SearchConfig) -> Column:
    """FULL for a wanted place or remote work, PARTIAL for a wanted country."""
    if not cfg.locations and not cfg.countries:
        return F.lit(FULL)
    hay = F.concat_ws(" ", blank_to_null(folded(location)), blank_to_null(folded(city)))
    in_place = F.lit(False)
    for place in sorted(wanted_places(cfg) - {"", "remote"}):
        in_place = in_place | F.contains(hay, F.lit(place))
    level = F.when(in_place, FULL)
    level = level.when(
        (remote == "remote") | F.contains(hay, F.lit("remote")),
        NONE if cfg.remote_preference == "onsite" else FULL,
    ).when(hay == "", UNKNOWN)
    if cfg.countries:
        own = blank_to_null(folded(country))
        near = F.lit(False)
        for wanted in cfg.countries:
            word = F.lit(wanted.lower())
            near = near | F.contains(own, word) | F.contains(word, own)
        level = level.when(near, PARTIAL).when(own.isNull(), UNKNOWN)
    return level.otherwise(NONE)


def experience_level(low: Column, high: Column, cfg: SearchConfig) -> Column:
    """Overlap of two ranges with open ends."""
    overlap = F.lit(True)
    if cfg.experience_max is not None:
        overlap = overlap & F.coalesce(low <= cfg.experience_max, F.lit(True))
    if cfg.experience_min is not None:
        overlap = overlap & F.coalesce(high >= cfg.experience_min, F.lit(True))
    return F.when(low.isNull() & high.isNull(), UNKNOWN).when(overlap, FULL).otherwise(NONE)


def employment_level(kind: Column, cfg: SearchConfig) -> Column:
    if not cfg.employment_types:
        return F.lit(FULL)
    wanted = [k.lower() for k in cfg.employment_types]
    return (
        F.when(blank_to_null(kind).isNull(), UNKNOWN).when(F.lower(kind).isin(*wanted), FULL).otherwise(NONE)
    )


def has_keyword(low_text: Column, keyword: str) -> Column:
    """Keyword in lower-case text, not inside a longer ASCII word.

    The plain substring test goes first: it is cheap and settles most rows. The pattern begins with the keyword itself,
    so that a text is searched for it; a look-behind in front would be tried at every character.
    """
    word = keyword.lower()
    quoted = re.escape(word)
    pattern = f"{quoted}(?<![a-z0-9]{quoted})(?![a-z0-9])"
    return F.contains(low_text, F.lit(word)) & low_text.rlike(pattern)


#: Most signs a span keeps on either side of its words, and most characters of a span without words.
EDGE = 4
#: Keywords tested against one copy of a text, about.
KEYWORDS_A_TEXT = 1000
#: Long numbers in a bitmap of :func:`_bitmap`: 256 kB, however many strings it stands for.
SLOTS = 1 << 15

_WORD = "[a-z0-9]+"


def _words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _pairs(words: Column, gaps: Column) -> Column:
    """Each word with the next one and what stands between them; null for the last word. ``gaps`` begin before the first word."""
    # zipped, since a lambda would work out both arrays again for every word
    rest = lambda c: F.slice(c, 2, 1 << 30)
    joined = lambda a, b: F.concat(a, b)
    return F.zip_with(F.zip_with(words, rest(gaps), joined), rest(words), joined)


def _pieces(chars: Column, n: int) -> Column:
    """Stretches of ``n`` neighbouring characters; nulls at the end."""
    return F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _place(s: Column) -> tuple[Column, Column]:
    return F.pmod(F.hash(s), F.lit(SLOTS)), F.pmod(F.xxhash64(s), F.lit(64)).cast("int")


def _bitmap(strings: DataFrame, name: str) -> DataFrame:
    """One row with a bitmap of fixed size, for :func:`_may_hold`, of the strings in the only column."""
    slot, bit = _place(F.col(strings.columns[0]))
    one = F.lit(1).cast("long")
    bits = strings.select(slot.cast("long").alias("slot"), F.call_function("shiftleft", one, bit).alias("bits"))
    empty = strings.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"))
    slots = bits.unionByName(empty).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "bits")))
    return slots.agg(F.transform(ordered, lambda s: s["bits"]).alias(name))


def _may_hold(bitmap: Column, s: Column) -> Column:
    """Whether a string may be one of the bitmap's: never false for one that is."""
    slot, bit = _place(s)
    return s.isNotNull() & (F.getbit(F.get(bitmap, slot), bit) == 1)


def _spans(words: Column, gaps: Column, bitmap: Column, sizes: list[int]) -> Column:
    """The distinct spans of a text that a bitmap may hold.

    A span stands in the text by the rule of :func:`has_keyword` and is one word, or two neighbours with what stands between
    them, with up to :data:`EDGE` signs on either side, or one of ``sizes`` characters without a word. ``gaps`` are what
    stands before, between and after the words, with a sign more at both ends of the text: so what a span takes of a gap
    always leaves one sign of it. Edges are tried only where the words alone are in the bitmap.
    """

    def edged(core: Column, left: Column, right: Column) -> Column:
        def most(gap: Column) -> Column:
            return F.sequence(F.lit(0), F.least(F.length(gap) - 1, F.lit(EDGE)))

        def both(i: Column) -> Column:
            start = F.concat(F.substring(left, -i, i), core)
            return F.transform(most(right), lambda j: F.concat(start, F.substring(right, F.lit(1), j)))

        plain = (F.length(left) == 1) & (F.length(right) == 1)
        return F.when(plain, F.array(core)).otherwise(F.flatten(F.transform(most(left), both)))

    def around(cores: Column, n: int) -> Column:
        none = F.array().cast("array<string>")
        return F.flatten(
            F.transform(
                cores, lambda c, i: F.when(_may_hold(bitmap, c), edged(c, F.get(gaps, i), F.get(gaps, i + n))).otherwise(none)
            )
        )

    parts = [around(words, 1), around(_pairs(words, gaps), 2)]
    if sizes:
        inner = F.transform(F.filter(F.array_distinct(gaps), lambda g: F.length(g) > 2), lambda g: F.slice(_chars(g), 2, F.length(g) - 2))
        parts.append(F.flatten(F.transform(inner, lambda cs: F.concat(*[_pieces(cs, n) for n in sizes]))))
    return F.array_distinct(F.filter(F.concat(*parts), lambda s: _may_hold(bitmap, s)))


def _looked_up(keywords: DataFrame) -> tuple[DataFrame, list[int]]:
    """``keyword, _low, _sure, _cores, _looked``: the spans a keyword is looked up by, and their words without edges.

    A keyword of at most two words goes by itself, as far as its edges are no longer than a span's; it stands in a text
    exactly when that span does if nothing was cut (``_sure``). Others go by all their pairs or pieces. Also
    the sizes of the spans without words.
    """
    n = F.col("_n")
    wanted = keywords.select("keyword", F.lower("keyword").alias("_low")).where(F.col("_low") != "").distinct()
    wanted = wanted.withColumns({"_words": _words(F.col("_low")), "_gaps": F.split("_low", _WORD, -1)})
    wanted = stage(wanted.withColumn("_n", F.size("_words")), "keywords")
    length = F.length("_low")
    sizes = wanted.where(n == 0).select(F.least(length, F.lit(EDGE)).alias("size")).distinct().collect()
    before, after = F.get("_gaps", F.lit(0)), F.get("_gaps", n)
    core = F.when(n == 1, F.get("_words", F.lit(0))).otherwise(F.concat(F.get("_words", F.lit(0)), F.get("_gaps", F.lit(1)), F.get("_words", F.lit(1))))
    span = F.concat(F.right(before, F.lit(EDGE)), core, F.left(after, F.lit(EDGE)))
    pieces = F.when(length <= EDGE, F.array("_low")).otherwise(_pieces(_chars(F.col("_low")), EDGE))
    several = F.when(n == 0, pieces).otherwise(_pairs(F.col("_words"), F.col("_gaps")))
    short = n.between(1, 2)
    whole = F.when(n == 0, length <= EDGE).otherwise(short & (F.length(before) <= EDGE) & (F.length(after) <= EDGE))
    looked = F.when(short, F.array(span)).otherwise(F.array_distinct(F.filter(several, lambda s: s.isNotNull())))
    asked = wanted.select("keyword", "_low", whole.alias("_sure"), F.when(short, F.array(core)).alias("_cores"), looked.alias("_looked"))
    return asked, sorted(r["size"] for r in sizes)


def keyword_table_hits(texts_table: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword") -> DataFrame:
    """``(key, keyword)`` for every keyword of a table that stands in a text, by the rule of :func:`has_keyword`.

    The plan does not grow with the number of keywords: the spans of texts (:func:`_spans`) that keywords have are joined by
    hash; a bitmap of fixed size keeps most others out of that join. A keyword that is a span needs no
    further test. The others look at the texts that hold their rarest span alone, and those of a text are tested together,
    so that the text is joined once for many of them.
    """
    wanted, sizes = _looked_up(keywords.select(F.col(keyword).alias("keyword")))
    asked = wanted.select("keyword", "_low", "_sure", F.explode("_looked").alias("_span"))
    known = wanted.select(F.explode(F.concat(F.coalesce("_cores", F.array().cast("array<string>")), "_looked")).alias("_span"))
    low = texts_table.select(F.col(key).alias("_key"), folded(F.col(text)).alias("_text"))
    padded = F.concat(F.lit(" "), "_text", F.lit(" "))
    # a file of one row group is read in one task; dealing the texts spreads the work on them
    tasks = int(texts_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = low.repartition(tasks, "_key").select("_key", _words(F.col("_text")).alias("_words"), F.split(padded, _WORD, -1).alias("_gaps"))
    spans = _spans(F.col("_words"), F.col("_gaps"), F.col("_known"), sizes)
    held = stage(parts.crossJoin(F.broadcast(_bitmap(known, "_known"))).select("_key", spans.alias("_spans")), "held")
    sure = held.select("_key", F.explode("_spans").alias("_span")).join(asked.where("_sure").select("keyword", "_span"), "_span").select("_key", "keyword")

    asked = asked.where("not _sure")
    few = F.filter("_spans", lambda s: _may_hold(F.col("_known"), s))
    few = held.crossJoin(F.broadcast(_bitmap(asked.select("_span"), "_known"))).select("_key", F.explode(few).alias("_span"))
    postings = stage(few.join(asked.select("_span").distinct(), "_span", "left_semi"), "postings")
    counts = postings.groupBy("_span").agg(F.count("*").alias("_texts"))
    # a keyword with a span that no text holds stands nowhere
    rarest = (
        asked.join(counts, "_span", "left")
        .groupBy("keyword", "_low")
        .agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "_span")).alias("r"))
        .where("r.n > 0")
        .select("keyword", "_low", F.col("r._span").alias("_span"))
    )
    near = stage(postings.join(rarest, "_span").select("_key", "keyword", "_low"), "near")
    shares = near.groupBy("_key").agg(F.ceil(F.count("*") / F.lit(KEYWORDS_A_TEXT)).alias("_shares"))
    dealt = near.join(shares, "_key").withColumn("_share", F.pmod(F.xxhash64("keyword"), F.col("_shares")))
    together = dealt.groupBy("_key", "_share").agg(F.collect_list(F.struct("keyword", "_low")).alias("_near"))

    def stands(k: Column) -> Column:
        quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(k["_low"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
        return F.contains(F.col("_text"), k["_low"]) & F.rlike(F.col("_text"), quoted)

    tested = together.join(low, "_key").select("_key", F.explode(F.filter("_near", stands)).alias("k")).select("_key", "k.keyword")
    return sure.unionByName(tested).select(F.col("_key").alias(key), "keyword")


def with_skills(postings: DataFrame, cfg: SearchConfig, where: Column | None = None) -> DataFrame:
    """Add which wanted skills a record names, in its list or its description.

    ``skills_found``, ``skills_missing`` and ``preferred_found`` keep the configured order;
    ``has_skill_data`` is false for a record with neither. The folded text and each skill's
    test are columns of their own, so that a long text is folded and searched once. Only texts of rows
    that meet ``where`` are folded and searched; the other rows go by their skill list alone. Rows with a
    ``search_text`` are searched there, but for skills that hold white space.
    """
    wanted = list(dict.fromkeys((*cfg.skills, *cfg.preferred_skills)))
    flag = {skill: f"_has_{i}" for i, skill in enumerate(wanted)}
    has_search = "search_text" in postings.columns
    bodies = {"_body": folded(F.col("description"))}
    if has_search:
        bodies["_loose"] = F.coalesce("search_text", F.lit(""))
    folded_rows = postings.withColumns(
        {
            **{name: c if where is None else F.when(where, c).otherwise("") for name, c in bodies.items()},
            "_listed": F.transform("skills", lambda s: F.lower(s)),
        }
    )
    told = F.coalesce(F.col("search_text").rlike(INKED), F.lit(False)) if has_search else F.coalesce("description", F.lit("")) != ""

    def present(skill: str) -> Column:
        named = F.coalesce(F.array_contains("_listed", skill.lower()), F.lit(False))
        return named | has_keyword(F.col("_loose" if has_search and is_unspaced(skill) else "_body"), skill)

    tested = folded_rows.withColumns(
        {
            **{flag[s]: present(s) for s in wanted},
            "has_skill_data": (F.coalesce(F.size("skills"), F.lit(0)) > 0) | told,
        }
    )
    return tested.withColumns(
        {
            "skills_found": texts(*[F.when(F.col(flag[s]), s) for s in cfg.skills]),
            "skills_missing": texts(*[F.when(~F.col(flag[s]), s) for s in cfg.skills]),
            "preferred_found": texts(*[F.when(F.col(flag[s]), s) for s in cfg.preferred_skills]),
        }
    ).drop(*bodies, "_listed", *flag.values())


def excluded_hit(title: Column, description: Column, cfg: SearchConfig, search_text: Column | None = None) -> Column:
    """First unwanted keyword, in configured order, inside the configured fields. ``search_text`` stands for the
    description where no keyword holds white space."""
    if not cfg.excluded_keywords:
        return _null()
    loose = search_text is not None and all(map(is_unspaced, cfg.excluded_keywords))
    known = {"title": folded(title), "description": search_text if loose else folded(description)}
    fields = [known[f] for f in (cfg.excluded_keyword_fields or ("title",)) if f in known]

    def first_in(blob: Column) -> Column:
        return _first(*[F.when((blob != "") & F.contains(blob, F.lit(k.lower())), k) for k in cfg.excluded_keywords])

    return once(first_in, F.concat_ws("\n", *[blank_to_null(c) for c in fields]))


def _with_cheap_levels(postings: DataFrame, cfg: SearchConfig) -> DataFrame:
    col = F.col
    role_level, role = title_level(col("title"), cfg.roles)
    return postings.withColumns(
        {
            "title_level": role_level,
            "role": role,
            "location_level": location_level(
                col("location"), col("city"), col("country"), col("remote_status"), cfg
            ),
            "experience_level": experience_level(col("experience_min"), col("experience_max"), cfg),
            "employment_level": employment_level(col("employment_type"), cfg),
            "excluded_hit": excluded_hit(
                col("title"), col("description"), cfg, col("search_text") if "search_text" in postings.columns else None
            ),
            "experience_text": experience_label(col("experience_min"), col("experience_max")),
        }
    )


def with_levels(postings: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Add each match level once; the filter and the score both read them."""
    return with_skills(_with_cheap_levels(postings, cfg), cfg)


def judge(postings: DataFrame, cfg: SearchConfig) -> DataFrame:
    """:func:`ordered_filter` over :func:`with_levels`, stopping at the first failed test: the long texts of
    rows that a test before the skills rejects are not searched, and their skill columns tell nothing."""
    return ordered_filter(searched(postings, cfg, matched=True), cfg)


def searched(postings: DataFrame, cfg: SearchConfig, matched: bool = False) -> DataFrame:
    """The levels that :func:`ordered_filter` reads, with texts searched as by :func:`judge`. Rows need not be ``matched``
    to entities yet: searched before, they go through that join without their texts, and only rows that nothing but the
    target would reject are searched beyond what :func:`judge` searches."""
    cheap = _with_cheap_levels(postings, cfg)
    cheap = cheap.withColumn("_alive", _first(*_early_failures(cfg, matched)).isNull())
    return with_skills(cheap, cfg, F.col("_alive")).drop("_alive")


def _early_failures(cfg: SearchConfig, matched: bool = True) -> list[Column]:
    """Reason of each failed test before the skills, in order; without the target's if rows are not ``matched``."""
    col, lit, say = F.col, F.lit, F.concat
    bounds = f"{cfg.experience_min}-{cfg.experience_max} yrs"
    failures: list[Column] = []
    if cfg.require_target_company and matched:
        failures.append(F.when(blank_to_null(col("target_match")).isNull(), "Not a target company"))
    failures.append(F.when(col("excluded_hit").isNotNull(), say(lit("Excluded keyword: "), col("excluded_hit"))))
    if cfg.roles:
        failures.append(
            F.when(col("title_level") == NONE, say(lit("No role match for '"), col("title"), lit("'")))
        )
    return failures + [
        F.when(
            col("location_level") == NONE,
            say(lit("Location not in list: "), F.coalesce("location", lit("unknown"))),
        ),
        F.when(
            col("experience_level") == NONE,
            say(lit("Experience "), col("experience_text"), lit(f" outside {bounds}")),
        ),
        F.when(
            col("employment_level") == NONE,
            say(lit("Employment type not wanted: "), col("employment_type")),
        ),
    ]


def ordered_filter(leveled: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Add ``accepted``, ``reject_reason`` (the first failed test) and ``notes``.

    Order: target, excluded word, role, location, experience, employment, skills. Unknown
    data never rejects, except for skills in ``all`` mode.
    """
    col, lit = F.col, F.lit
    say = F.concat
    n_found = F.size("skills_found")
    failures = _early_failures(cfg)
    short = n_found < cfg.min_skill_matches
    if cfg.skills and cfg.skill_match_mode == "all":
        failures.append(
            F.when(
                F.size("skills_missing") > 0,
                say(lit("Missing required skills: "), F.array_join("skills_missing", ", ")),
            )
        )
    elif cfg.skills:
        failures.append(
            F.when(
                short & col("has_skill_data"),
                say(lit("Only "), n_found.cast("string"), lit(f"/{cfg.min_skill_matches} required skills matched")),
            )
        )

    notes: list[Column] = []
    if cfg.roles:
        notes += [
            F.when((col("title_level") == FULL), say(lit("Role match: "), col("role")))
            .when(col("title_level") == PARTIAL, say(lit("Partial role match: "), col("role")))
            .when(col("title_level") == UNKNOWN, "Title missing - role not verified")
        ]
    notes += [
        F.when(
            col("location_level") == FULL,
            say(lit("Location match: "), F.coalesce("location", lit("remote"))),
        ).when(col("location_level") == UNKNOWN, "Location not listed"),
        F.when(col("experience_level") == FULL, say(lit("Experience match: "), col("experience_text"))).when(
            col("experience_level") == UNKNOWN, "Experience not listed"
        ),
        F.when(
            col("employment_level") == FULL,
            say(lit("Employment type match: "), blank_to_null(col("employment_type"))),
        ),
    ]
    if cfg.skills:
        if cfg.skill_match_mode == "any":
            notes.append(F.when(short, "Skills not listed"))
        notes.append(F.when(n_found > 0, say(lit("Skills matched: "), F.array_join("skills_found", ", "))))

    decided = leveled.withColumn("reject_reason", _first(*failures))
    accepted = col("reject_reason").isNull()
    return decided.withColumns(
        {
            "accepted": accepted,
            "notes": F.when(accepted, texts(*notes)).otherwise(F.array("reject_reason")),
        }
    )


def listed(
    postings: DataFrame, active_only: bool = True, status: str | None = None, min_score: int | None = None
) -> DataFrame:
    """Rows by activity, status and least score; a missing score fails a least score."""
    out = postings.where("is_active") if active_only else postings
    if status is not None:
        out = out.where(F.col("status") == status)
    if min_score is not None:
        out = out.where(F.col("match_score") >= min_score)
    return out


def relevant(postings: DataFrame, cfg: SearchConfig) -> DataFrame:
    return postings.where(F.col("match_score") >= cfg.minimum_match_score)


def is_high_match(cfg: SearchConfig, score: str = "match_score") -> Column:
    return F.coalesce(F.col(score) >= cfg.high_match_score, F.lit(False))
