import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolecall.operators.match import with_priority
from rolecall.operators.rank import ranked
from rolecall.plans.exports import COLUMNS, export_views, records, write_views
from rolecall.plans.reports import error_report, new_report, run_report, status_report
from rolecall.plans.run import run
from rolecall.plans.state import StateStore
from rolecall.sources.feeds import entity_rows, read_nested_json
from rolecall.sources.registry import Source, careers_review, file_feed, register_source
from tests import golden

DAY0 = dt.datetime(2026, 11, 1, tzinfo=dt.UTC)


def entity_table(spark):
    rows = [(n, d, None, p, "false") for n, d, p in golden.ENTITIES] + [("Open Co", None, "https://o.test/c", "A", "yes")]
    table = spark.createDataFrame(rows, "company_name string, company_domain string, careers_url string, priority string, enabled string")
    return entity_rows(table)[0]


@pytest.fixture(scope="module")
def two_runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    feed = folder / "feed.json"
    feed.write_text(json.dumps({"jobs": golden.ROWS}))
    register_source(file_feed("fixture", lambda s: read_nested_json(s, str(feed))))
    register_source(careers_review())

    def broken(spark, scope):
        raise OSError("no such feed")

    register_source(Source("broken", broken))
    store = StateStore(spark, str(folder / "state"))
    configured = {"fixture": False, "greenhouse": True, "generic": True, "broken": True}
    first = run(spark, store, golden.CONFIG, entity_table(spark), configured, DAY0, keys=["fixture"])
    v1 = store.latest()
    second = run(spark, store, golden.CONFIG, entity_table(spark), configured, DAY0 + dt.timedelta(days=8),
                 keys=["fixture", "greenhouse", "generic", "broken"])
    return store, first, v1, second


def test_first_run(two_runs):
    store, first, v1, _ = two_runs
    c = first.counters
    assert (c["jobs_found"], c["new_jobs"], c["duplicates"], c["updated_jobs"]) == (14, 12, 2, 2)
    assert (c["filtered_out"], c["high_match"], c["below_threshold"], c["errors"]) == (5, 5, 0, 0)
    judged = first.decisions.where("evaluated").collect()
    assert {r.source_job_id: (r.reject_reason, r.match_score) for r in judged} == golden.OUTCOMES
    assert store.read(v1, "refs").count() == 14
    assert store.read(v1, "tracking").count() == 12
    assert store.read(v1, "content").where("is_fixture").count() == 12


def test_rank_after_first_run(two_runs):
    store, _, v1, _ = two_runs
    rows = records(store.read(v1, "content"), store.read(v1, "tracking")).where("match_score IS NOT NULL")
    order = [r.source_job_id for r in ranked(with_priority(rows, store.read(v1, "entities"))).collect()]
    assert order == golden.RANKED


def test_second_run_adds_nothing(two_runs):
    store, _, _, second = two_runs
    c = second.counters
    assert (c["new_jobs"], c["duplicates"], c["manual_review"], c["errors"]) == (0, 14, 1, 1)
    assert c["sources_not_available"] == 1 and c["companies_processed"] == 1
    now = store.latest()
    tracking = store.read(now, "tracking").collect()
    assert len(tracking) == 12
    # eight days later every record has aged from NEW to SEEN
    assert {r.status for r in tracking} == {"SEEN"}
    assert {r.times_seen for r in store.read(now, "refs").collect()} == {2}
    assert {r.source_job_id: r.match_score for r in tracking} == {k: v[1] for k, v in golden.OUTCOMES.items()}
    sources = {r.source: r for r in store.read(now, "sources").collect()}
    assert sources["fixture"].jobs_found == 28 and sources["fixture"].status == "OK"
    assert sources["greenhouse"].status == "NOT_AVAILABLE"
    assert sources["generic"].status == "MANUAL_REVIEW"
    assert sources["broken"].status == "FAILED" and sources["broken"].last_error == "no such feed"
    kinds = sorted(r.error_type for r in store.read(now, "errors").collect())
    assert kinds == ["FAILED", "MANUAL_REVIEW", "OSError"]


def test_reports(two_runs):
    store, *_ = two_runs
    now = store.latest()
    t = {name: store.read(now, name) for name in ("tracking", "refs", "entities", "sources", "errors", "runs")}
    report = {r.metric: r.value for r in run_report(t["runs"]).collect()}
    assert report["jobs_found"] == 14 and report["new_jobs"] == 0
    at = F.lit(DAY0 + dt.timedelta(days=8)).cast("timestamp")
    status = {r.metric: r.value for r in status_report(t["tracking"], t["refs"], t["entities"], t["sources"], t["errors"], at).collect()}
    assert status["jobs_total"] == 12 and status["job_source_refs"] == 14 and status["status:SEEN"] == 12
    assert status["jobs_new_7d"] == 0 and status["companies"] == 8 and status["companies_enabled"] == 1
    new = {r.metric: r.value for r in new_report(t["tracking"], F.lit(DAY0).cast("timestamp") - F.expr("INTERVAL 1 HOUR"), at).collect()}
    assert new == {"since_last_run": 12, "last_24h": 0, "last_7d": 0}
    assert error_report(t["errors"]).count() == 3


def test_exports(two_runs, tmp_path):
    store, *_ = two_runs
    now = store.latest()
    names = ("content", "tracking", "refs", "entities", "sources", "errors", "discovery")
    views = export_views(*[store.read(now, n) for n in names], golden.CONFIG)
    assert len(views) == 7
    rows = views["all_active"].collect()
    assert tuple(views["all_active"].columns) == COLUMNS and len(rows) == 12
    assert rows[0]["Match Score"] == "81" and rows[0]["Status"] == "SEEN [FIXTURE]"
    assert "WARNING: Salary unavailable" in rows[0]["Match Reasons"]
    assert views["high_match"].count() == 5 and views["new_jobs"].count() == 0
    paths = write_views(views, str(tmp_path), "csv", one_file=True)
    back = store.spark.read.csv(paths[2], header=True)
    assert back.count() == 12


def test_stale_records_close_but_stay(spark, two_runs):
    store, *_ = two_runs
    configured = {"fixture": True}
    empty = store.spark.createDataFrame([], store.read(store.latest(), "entities").schema)
    from rolecall.plans.run import ingest
    from rolecall.schemas import RAW

    ingest(store, golden.CONFIG, spark.createDataFrame([], RAW), DAY0 + dt.timedelta(days=40),
           entities=empty.select("name", "domain", "careers_url", "priority", "enabled", "ats"), configured=configured)
    now = store.latest()
    tracking = store.read(now, "tracking").collect()
    assert len(tracking) == 12 and {r.status for r in tracking} == {"INACTIVE"}
    assert not any(r.is_active for r in tracking)
    entities = {r.name: r.enabled for r in store.read(now, "entities").collect()}
    # referenced entities are switched off, the unreferenced one is gone
    assert len(entities) == 7 and not any(entities.values())
    kinds = sorted(r.error_type for r in store.read(now, "errors").collect())
    assert kinds == ["FAILED", "OSError"]


def test_broken_lines_become_error_rows(spark, tmp_path):
    from rolecall.sources.feeds import read_json_lines_checked
    from rolecall.sources.registry import Scope, Source, collect_sources

    lines = ['{"company_name": "A", "title": "x", "posted_date": 1700000000}', "{broken", "", '{"company_name": "B", "posted_date": "2026"}', "no json"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    scope = Scope(spark.createDataFrame([], "name string, careers_url string"), None, None)
    source = Source("feed", lambda s, _: read_json_lines_checked(s, str(tmp_path / "a.json")), "board")
    got = collect_sources(spark, [source], [], scope)
    assert sorted((r.company_name, r.posted_date) for r in got.raw.collect()) == [("A", "2023-11-14T22:13:20+00:00"), ("B", "2026")]
    assert sorted((r.source, r.error_type, r.message) for r in got.errors.collect()) == [
        ("feed", "INGEST", "unreadable record: no json"),
        ("feed", "INGEST", "unreadable record: {broken"),
    ]
    assert got.results.where("status = 'OK'").first()["n_jobs"] == 2
