"""State as a base and change sets, ordered exports, exact places."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolecall.operators.rank import numbered
from rolecall.plans.exports import read_in_order, read_manifest, write_in_order
from rolecall.plans.state import COMPACT_SHARE, StateStore
from rolecall.schemas import TRACKING

ROWS = 20_000


def tracking(spark, n, start=0, status="NEW"):
    at = F.lit(dt.datetime(2026, 1, 1)).cast("timestamp")
    known = {"job_id": F.col("id"), "status": F.lit(status), "is_active": F.lit(True), "first_seen": at, "last_seen": at, "content_hash": F.sha2(F.col("id").cast("string"), 256)}
    kinds = {f.name: f.dataType for f in TRACKING}
    return spark.range(start, start + n).select(*[known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in TRACKING.names])


@pytest.fixture()
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"))


def test_a_run_rewrites_what_it_changed(spark, store):
    """One percent of the rows changed or added: under a tenth of the bytes, and the newest rows are read."""
    v1 = store.commit(store.latest(), {"tracking": tracking(spark, ROWS)}, 0, 0)
    v2 = store.commit(v1, {"tracking": tracking(spark, ROWS // 100, ROWS - ROWS // 200, "SEEN")}, 0, 0)
    base, change = v2.tables["tracking"]
    assert base == v1.tables["tracking"][0] and store.size(change) < 0.1 * store.size(base)
    now = store.read(v2, "tracking")
    assert now.count() == ROWS + ROWS // 200 and now.where("status = 'SEEN'").count() == ROWS // 100
    assert now.select("job_id").distinct().count() == now.count()
    assert store.read(v1, "tracking").where("status = 'SEEN'").count() == 0
    # the base is joined where it is read: it is not shuffled
    plan = now._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_later_changes_win_and_are_compacted(spark, store):
    version = store.commit(store.latest(), {"tracking": tracking(spark, ROWS)}, 0, 0)
    for i, name in enumerate(("A", "B", "C")):
        version = store.commit(version, {"tracking": tracking(spark, 30, 10 * i, name)}, 0, 0)
    assert len(version.tables["tracking"]) > 1
    got = {r["job_id"]: r["status"] for r in store.read(store.latest(), "tracking").collect()}
    assert len(got) == ROWS and [got[i] for i in (0, 9, 10, 19, 20, 49, 50)] == ["A", "A", "B", "B", "C", "C", "NEW"]
    version = store.commit(version, {"tracking": tracking(spark, 15_000, 100, "D")}, 0, 0)
    assert COMPACT_SHARE < 0.5 and len(version.tables["tracking"]) == 1  # a new base
    assert store.read(version, "tracking").groupBy("status").count().where("status = 'D'").first()["count"] == 15_000


def test_vacuum_keeps_what_versions_show(spark, store):
    version = store.latest()
    for i in range(4):
        version = store.commit(version, {"tracking": tracking(spark, 100, 0, f"S{i}"), "sources": store.read(version, "sources")}, 0, 0)
    gone = store.vacuum(keep=1)
    assert any(g.startswith("_commits/") for g in gone) and any(g.startswith("sources/") for g in gone)
    assert store.latest() == version and store.read(version, "tracking").where("status = 'S3'").count() == 100
    assert store.vacuum(keep=1) == []


def test_places_and_ordered_files(spark, tmp_path):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("score"), "id", F.concat(F.lit('a "quoted", text\nof two lines '), F.col("id")).alias("text"))
    order = [F.col("score").desc(), F.col("id").asc()]
    want = [(r["id"], i + 1) for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["score"], r["id"])))]
    assert [tuple(r) for r in numbered(rows.withColumn("rank", F.lit("clash")), order).orderBy("rank").select("id", "rank").collect()] == want
    assert numbered(rows.limit(0), order).count() == 0
    folder = str(tmp_path / "out")
    parts = write_in_order(rows, order, folder)
    assert read_manifest(spark, folder) == parts and sum(p.rows for p in parts) == 5000 and parts[0].first == 1
    back = read_in_order(spark, folder, rows.schema)
    assert [(r["id"], r["rank"]) for r in back.orderBy("rank").collect()] == want
    assert back.where("text = concat('a \"quoted\", text\\nof two lines ', id)").count() == 5000
