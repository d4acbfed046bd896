import dataclasses
import datetime as dt
import re
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rolecall.config import SearchConfig
from rolecall.functions import dates, text, urls
from rolecall.functions.identity import entity_key
from rolecall.operators import predicates as pred
from rolecall.operators.firsts import latest_review_rows
from rolecall.operators.identity import resolve_batch
from rolecall.operators.lifecycle import touch
from rolecall.operators.match import match_entities
from rolecall.operators.normalize import normalize_postings
from rolecall.operators.score import with_score
from rolecall.plans.run import decide, judged_facts
from rolecall.schemas import CONTENT, REFS, TRACKING
from rolecall.session import stage
from rolecall.sources.registry import available_sources, compact_seq, register_source, Source, select_sources
from rolecall.workload.catalog import all_queries
from rolecall.workload.matching import judged
from tests import golden


def one_column(spark, values, rule):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_text(spark):
    values = [None, "", "  ", "a \tb\x1cc ", "x"]
    assert one_column(spark, values, text.clean_text) == [None, None, None, "a b c", "x"]


def test_numbers(spark):
    values = ["3", " -2.9 ", "1e2", "12d", "NaN", "", None, "1_000", "inf", "99999999999"]
    assert one_column(spark, values, text.to_int) == [3, -2, 100, None, None, None, None, 1000, None, None]
    assert one_column(spark, ["-5", "30-50", "1.2.3", "$1,250.5", "x", None], text.to_float) == [
        5.0, 3050.0, None, 1250.5, None, None,
    ]


def test_links(spark):
    values = [
        "https://Example.com:443/jobs/1?utm_source=x&fbclid=9#top", "HTTP://A.b/", "https://a.b?z=1&y=2&y=1",
        "no/scheme/", "https://a.b/p//?q=a+b%7E*", None, "https://a.b//",
    ]
    assert one_column(spark, values, urls.canonical_url) == [
        "https://example.com/jobs/1", "http://a.b/", "https://a.b/?y=1&y=2&z=1", "no/scheme",
        "https://a.b/p?q=a+b~%2A", None, "https://a.b",
    ]
    # a path of slashes only loses all of them at first; every other form is stable
    once = one_column(spark, values[:-1], urls.canonical_url)
    assert one_column(spark, once, urls.canonical_url) == once


def test_dates(spark):
    values = ["2026-10-04", "4 Oct 2026", "Oct 04, 2026", "not a date", None, "2026-10-04T10:00:00Z", "0", "10:30", "2026-02-30", "2026", "5"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = [r.d for r in dates.with_dates(rows, {"d": F.col("v")}).orderBy("i").collect()]
    day = "2026-10-04T00:00:00"
    assert out == [day, day, day, None, None, "2026-10-04T10:00:00+00:00", None, None, None, None, None]
    numbers = spark.createDataFrame([(0.0,), (1.5,), (-1.0,), (1e18,), (None,)], "v double")
    out = [r.d for r in dates.with_dates(numbers, {"d": F.col("v")}).collect()]
    assert out == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00", "1969-12-31T23:59:59+00:00", None, None]


def test_entity_key(spark):
    keys = one_column(spark, ["ABC Technologies Pvt. Ltd.", "ABC Technologies", "ABC Tech", None], entity_key)
    assert keys == ["abc technologies", "abc technologies", "abc tech", ""]


POSTING = (
    "target_match string, title string, location string, city string, country string, remote_status string, "
    "employment_type string, experience_min int, experience_max int, skills array<string>, description string, "
    "salary_min double, salary_max double"
)
GOOD = ("Acme", "Backend Engineer", "Bangalore, India", "Bangalore", "India", "onsite", "full_time", 3, 5,
        ["Python", "Node.js", "React", "SQL", "Azure"], "Power BI", None, None)


def judge(spark, cfg=golden.CONFIG, **changes):
    names = [f.split()[0] for f in POSTING.split(", ")]
    row = {**dict(zip(names, GOOD, strict=True)), **changes}
    rows = pred.with_levels(spark.createDataFrame([tuple(row[n] for n in names)], POSTING), cfg)
    return with_score(pred.ordered_filter(rows, cfg), cfg).first()


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"target_match": None}, "Not a target company"),
        ({"title": "Director of Engineering"}, "Excluded keyword: director"),
        ({"title": "Graphic Designer"}, "No role match for 'Graphic Designer'"),
        ({"title": ""}, None),
        ({"location": "Kolkata, India", "city": "Kolkata"}, "Location not in list: Kolkata, India"),
        ({"location": "Bombay", "city": None}, None),
        ({"location": None, "city": None}, None),
        ({"experience_min": 8, "experience_max": 12}, "Experience 8-12 yrs outside 3-6 yrs"),
        ({"experience_min": None, "experience_max": None}, None),
        ({"employment_type": "internship"}, "Employment type not wanted: internship"),
        ({"skills": ["Go"], "description": "pythonic"}, "Only 0/1 required skills matched"),
        ({"skills": [], "description": None}, None),
    ],
)
def test_ordered_filter(spark, changes, reason):
    assert judge(spark, **changes).reject_reason == reason


def test_last_half_matching_role_wins(spark):
    assert judge(spark, title="FastAPI Engineer").role == "ml engineer"


def test_scores(spark):
    full = judge(spark)
    assert full.match_score == 91  # 30 + 30 * 5.5 / 8 + 20 + 15 + 5 = 90.625
    assert "Salary unavailable" in full.match_warnings
    no_roles = judge(spark, SearchConfig(require_target_company=False))
    # no roles pass the filter but earn nothing for the title
    assert no_roles.accepted and no_roles.match_score == 57


def test_reviews_keep_latest_only(spark):
    rows = [(1, "g", "A", "MANUAL_REVIEW"), (2, "g", "A", "MANUAL_REVIEW"), (3, "g", None, "MANUAL_REVIEW"),
            (4, "g", None, "MANUAL_REVIEW"), (5, "g", "A", "FAILED"), (6, "g", "A", "FAILED")]
    out = latest_review_rows(spark.createDataFrame(rows, "error_id long, source string, company string, error_type string"))
    assert sorted(r.error_id for r in out.collect()) == [2, 4, 5, 6]


def test_touch_ages_and_never_reopens(spark):
    old, now = dt.datetime(2020, 1, 1), dt.datetime(2026, 1, 1)
    rows = [(1, "NEW", old, old, True, old), (2, "INACTIVE", old, old, False, old), (3, "NEW", old, old, True, old)]
    table = spark.createDataFrame(
        rows, "job_id long, status string, first_seen timestamp, last_seen timestamp, is_active boolean, updated_at timestamp"
    )
    seen = spark.createDataFrame([(1, now), (2, now)], "job_id long, seen_at timestamp")
    got = {r.job_id: (r.status, r.is_active, r.last_seen.year) for r in touch(table, seen, 7).collect()}
    assert got == {1: ("SEEN", True, 2026), 2: ("INACTIVE", False, 2026), 3: ("NEW", True, 2020)}
    again = {r.job_id: r.is_active for r in touch(table, seen, 7, reactivate=True).collect()}
    assert again[2] is True


def test_source_choice():
    register_source(Source("one", lambda s, c: None))
    register_source(Source("two", lambda s, c: None, "company"))
    configured = {"one": True, "two": False, "ghost": True}
    runnable, missing = select_sources(configured)
    assert [s.key for s in runnable] == ["one"] and missing == ["ghost"]
    runnable, missing = select_sources(configured, ["two", "unknown"])
    assert [s.key for s in runnable] == ["two"] and missing == []
    assert select_sources(configured, ["one", "two"], "company")[0][0].key == "two"
    assert {"one", "two"} <= set(available_sources())


def test_compact_seq_keeps_order(spark):
    rows = spark.createDataFrame([(5,), (1 << 40,), ((1 << 40) + 3,), (1 << 50,)], "seq long")
    got = [r.seq for r in compact_seq(rows, 2).orderBy("seq").collect()]
    assert got == [(2 << 20) + 5, 3 << 20, (3 << 20) + 3, 4 << 20]


def test_many_keywords_without_letters(spark):
    """Any number of them, and keywords of one word, a pair and more words, by the rule of one keyword."""
    bare = [chr(0x400 + i) + chr(0x430 + i % 32) for i in range(120)] + ["(", "--", "\U0001f600", "é è ü"]
    keywords = [*bare, "C++", "a b", "A  b", "a b c", "(a", "b.", "b", "\\E.x", "no such", "x-"]
    texts = [None, "", "a b c", "xa b", "(a  b.) -- c++", "1-- --", "é è ü (", "\U0001f600\U0001f600 \\E.x ab", "x--b.", "a b a b c.", "x- xx-", "".join(bare[:110])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([(k,) for k in [*keywords, "", "b"]], "keyword string")
    got = pred.keyword_table_hits(docs, words, "doc_id").collect()
    low = [(t or "").lower() for t in texts]
    rule = lambda t, k: re.search(f"(?<![a-z0-9]){re.escape(k.lower())}(?![a-z0-9])", t)
    assert sorted((r.doc_id, r.keyword) for r in got) == sorted((i, k) for i, t in enumerate(low) for k in keywords if rule(t, k))


def test_keywords_with_edges_need_no_further_test(spark, monkeypatch):
    """Keywords of up to two words, and of a few signs, are spans of the texts themselves: no text is searched again for them,
    however many texts hold their words. Longer ones still are."""
    staged = []
    real = pred.stage
    monkeypatch.setattr(pred, "stage", lambda df, name="stage": staged.append((name, real(df, name))) or staged[-1][1])
    edges = ["", ",", "(", "((", "--", " ", "\n", "é", "😀", "----", "-----", "...--"]
    keywords = sorted({a + core + b for a in edges for core in ("la", "la le", "", "la, le") for b in edges} - {""} | {"la le lu", "x"})
    gaps = [" ", ", ", "(", " ((", "--", "-----", "------", "\n\n", "é", "aé", "😀😀", "...--.", "X", "A\x00"]
    texts = [a + "La" + b + "le" + c + "lu" for a in ("", *gaps) for b in gaps for c in gaps] + [g + h for g in gaps for h in gaps] + ["", None, "la", "(la", "la)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    got = sorted((r.doc_id, r.keyword) for r in pred.keyword_table_hits(docs, words, "doc_id").collect())
    rules = [(k, re.compile(f"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])")) for k in keywords]
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, rule in rules if rule.search((t or "").lower()))
    tested = {r.keyword for name, df in staged if name == "near" for r in df.collect()}
    long = re.compile(r"^[^a-z0-9]{5}|[^a-z0-9]{5}$|la le lu")
    assert tested and all(long.search(k) for k in tested)


def test_squeeze_of_every_white_space(spark):
    """Runs of any white space become one space; tidy text has nothing to replace."""
    pieces = ["", " ", "  ", "\n", " \n", "\n ", "\t\t", "\x1c", "\x1f ", "\x85", " ", "  ", "  ", "　", "\r\n", "​", "᠎"]
    rows = [(a + "x" + b + "y z" + c + "\U0001f600" + a,) for a in pieces for b in pieces for c in pieces]
    seen = spark.createDataFrame(rows, "t string").select("t", text.squeeze(F.col("t")), text.long_text(text.squeeze, F.col("t"))).collect()
    for given, once, long in seen:
        want = re.sub("[\\s]+", " ", given).strip(" ")
        assert once == want and long == want
    assert spark.sql("SELECT 'a b c' AS t").select(F.regexp_count("t", F.lit(text.UNTIDY))).first()[0] == 0


def test_long_text_is_no_part_of_a_generated_method(spark):
    """The rule over the description is worked out by itself: a huge method would be interpreted."""
    raw = spark.createDataFrame([(1, "a  b", "c \n d")], "seq long, title string, description string")
    plan = normalize_postings(raw).select("title", "description")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(description" in plan and "regexp_replace(description" not in plan


def test_hints_are_folded_only_where_no_mode_is_stated(spark):
    rows = [("Remote", "hybrid"), ("flexible", "a Hybrid job"), (None, "Work FROM home"), (None, None), ("office", "wfh")]
    raw = spark.createDataFrame(rows, "remote_status string, description string").withColumn("seq", F.lit(1))
    assert [r[0] for r in normalize_postings(raw).select("remote_status").collect()] == ["remote", "hybrid", "remote", "unknown", "onsite"]
    stated = raw.select(text.hint_text(F.lower("remote_status"), F.col("description")).alias("h")).collect()
    assert [r[0] for r in stated] == [None, "a hybrid job", "work from home", "", None]


def test_keyword_pattern_begins_with_the_keyword(spark):
    """The same answers as with a look-behind in front, which would be tried at every character."""
    words = ["the", "c++", "a a", ".js", "tat", "-", "9", "é"]
    texts_ = ["the", "xthe the", "bathe", "the9", "ethe_the", "c++", "c+++", "xc++ (c++)", "a a a", "ba a a", "node.js", " .js", "tatat", "tatat tat", "--", "a-", "19 9", "éé", "xé", ""]
    rows = spark.createDataFrame([(t,) for t in texts_], "t string")
    hits = rows.select("t", *[pred.has_keyword(F.col("t"), w).alias(str(i)) for i, w in enumerate(words)])
    for row in hits.collect():
        for i, w in enumerate(words):
            assert row[str(i)] == bool(re.search(r"(?<![a-z0-9])" + re.escape(w) + r"(?![a-z0-9])", row["t"])), (row["t"], w)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE(t#0, (?<!" not in plan and ", (?<!" not in plan


def test_searches_of_descriptions_need_no_squeezed_text(spark):
    """Words are found before white space is squeezed as they are after; skills with white space still need it."""
    pieces = ["", "the", " the ", "the\ncat", "a  the　b", "bathe", "der\x1c", "the  cat", "the cat", " \n ", "THE\tCat", "promo\n", None]
    raw = spark.createDataFrame(
        [(i, t, s) for i, (t, s) in enumerate((t, s) for t in pieces for s in (None, "x; the"))], "seq long, description string, skills string"
    )
    cfg = SearchConfig(skills=("the", "der", "the cat"), preferred_skills=("cat",), excluded_keywords=("promo", "cat"), excluded_keyword_fields=("title", "description"))
    rows = normalize_postings(raw)
    shown = ["seq", "skills_found", "skills_missing", "preferred_found", "has_skill_data", "excluded_hit"]
    fast = pred.with_levels(rows, cfg).select(*shown)
    assert sorted(fast.collect()) == sorted(pred.with_levels(rows.drop("search_text"), cfg).select(*shown).collect())
    words = dataclasses.replace(cfg, skills=("the", "der"))
    plan = pred.with_levels(rows, words).select(*shown)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(description" not in plan and "lower(description" in plan


def test_title_words_are_worked_out_once(spark):
    rows = spark.createDataFrame([("Small red  widget",)], "title string")
    level, role = pred.title_level(F.col("title"), ("red old plate", "small blue widget", "hot rod"))
    shown = rows.select(level.alias("level"))
    assert shown.first()[0] == "PARTIAL" and rows.select(role.alias("r")).first()[0] == "small blue widget"
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_texts_do_not_go_through_the_joins_of_decide(spark):
    """A row is judged before it meets its record; only judged rows keep a verdict."""
    raw = spark.createDataFrame([(0, "x", "a the"), (1, "x", "none")], "seq long, title string, description string")
    rows = normalize_postings(raw).drop("search_text").withColumns({"target_match": F.lit("t"), "entity_id": F.lit(1).cast("long"), "match_confidence": F.lit("HIGH")})
    rows = stage(rows, "rows")
    resolved = spark.createDataFrame([(0, 1, True, False), (1, 1, False, False)], "seq long, job_id long, is_new boolean, promoted boolean")
    got = decide(rows, resolved, spark.createDataFrame([], CONTENT), SearchConfig(skills=("the",)))
    assert [(r.accepted, r.data_changed) for r in got.orderBy("seq").collect()] == [(True, False), (None, True)]
    parents: list[tuple[int, str]] = []
    for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        parents = [p for p in parents if p[0] < depth]
        if parents and "Join" in parents[-1][1]:
            shown = line.split("[", 1)[1].split("]")[0] if "Project [" in line else line
            assert not re.search(r"(^|, )description#\d+(,|$)", shown) and "Relation" not in line.split("[")[0], line
        parents.append((depth, line.split("[")[0]))


def test_texts_do_not_go_through_the_join_with_entities(spark):
    """Rows are judged as if they had been matched before; the join moves no description."""
    raw = spark.createDataFrame([(0, "x", "Acme", "a the"), (1, "x", "Other", "a the"), (2, "x", "Acme", "none"), (3, "y", "Acme", "the")], "seq long, title string, company_name string, description string")
    entities = spark.createDataFrame([(7, "Acme", None, None, "A", True)], "entity_id long, name string, domain string, careers_url string, priority string, enabled boolean")
    cfg = SearchConfig(roles=("x",), skills=("the",), require_target_company=True)
    tables = SimpleNamespace(postings=raw, entities=entities)
    got = judged(tables, cfg)
    shown = ["seq", "accepted", "reject_reason", "notes", "target_match"]
    assert sorted(got.select(*shown).collect()) == sorted(pred.judge(match_entities(normalize_postings(raw), entities), cfg).select(*shown).collect())
    assert [r.accepted for r in got.orderBy("seq").collect()] == [True, False, False, False]
    moved = []
    for line in got.select(*shown)._jdf.queryExecution().optimizedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if moved and depth == moved[-1][0] + 3 and "Project [" in line:
            moved[-1][1].append(re.sub(r" AS \w+#\d+", "", line.split("Project ", 1)[1].rsplit("]", 1)[0]))
        if "Join" in line:
            moved.append((depth, []))
    shown = [p for _, projects in moved for p in projects]
    assert any("skills_found" in p or "_has_0" in p for p in shown)
    assert not any(re.search(r"(\[|, )(description|search_text)#\d+(,|$)", p) for p in shown)


def test_incremental_run_stages_no_text_and_drops_finished_tables(spark, monkeypatch):
    """Rows are judged while their texts are at hand; of the tables staged on the way only what is still read is left."""
    from rolecall import session

    wide = []
    real = session._staged
    monkeypatch.setattr(session, "_staged", lambda df, name: wide.append((name, set(df.columns))) or real(df, name))
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    rows = all_queries()["incremental_run"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {"rows", "arrivals", "round", "resolved"} <= {name for name, _ in wide}
    assert not [name for name, columns in wide if columns & {"description", "search_text"}]
    left = {place.name.split("-")[0] for place in set(folder.iterdir()) - before}
    assert left == {"rows", "resolved", "decisions", "refs", "tracking"}
    assert spark.conf.get(session.TIDY) == "false"


def test_verdicts_before_or_while_deciding(spark):
    """Rows judged before they are decided need no text and get the same decisions."""
    cfg = SearchConfig(skills=("the",), roles=("clerk",), require_target_company=True)
    raw = spark.createDataFrame(
        [(i, "s", f"i{i % 3}", "Clerk" if i % 2 else "Cook", "all the news" if i % 4 else "none", "x" if i % 5 else "y") for i in range(12)],
        "seq long, source string, source_job_id string, title string, description string, company_name string",
    )
    entities = spark.createDataFrame([(7, "X", None, None, "A", True)], "entity_id long, name string, domain string, careers_url string, priority string, enabled boolean")
    postings = normalize_postings(raw)
    rows = stage(match_entities(postings, entities), "rows")
    none = [spark.createDataFrame([], layout) for layout in (TRACKING, REFS, CONTENT)]
    resolved = stage(resolve_batch(rows, *none[:2]), "resolved")
    now = decide(rows.drop("search_text"), resolved, none[2], cfg)
    told = stage(judged_facts(postings, entities, cfg), "told")
    assert "description" not in told.columns
    assert sorted(map(str, decide(told, resolved, none[2], cfg).collect())) == sorted(map(str, now.collect()))
