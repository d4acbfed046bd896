"""The numbered queries and the pipeline on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from rolecall.llm.queries import QUERIES, SQL
from tests.compare import connect, difference
from tests.llm import brute

FOLDER = os.environ.get("ROLECALL_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def rows():
    return connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()


def result(spark, name):
    return contract.queries()[name](spark, FOLDER)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(QUERIES) < set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(FOLDER), name, contract.queries(), SQL, FOLDER) == ""


def test_op1(spark, rows):
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in result(spark, "op1_secret_scan").collect()}
    want = {i: brute.op1(t) for i, t in rows}
    assert got == {i: (*[sum(s.startswith(k) for s in w) for k in ("assign", "access", "hex")], brute.sha(",".join(w))) for i, w in want.items()}


def test_op8(spark, rows):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in result(spark, "op8_license_scan").collect()}
    assert got == {i: brute.op8(t) for i, t in rows}


def test_op9(spark, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, "op9_substring_dedup").collect()}
    assert got == brute.op9(rows)


def test_op10(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, "op10_jaccard_join").collect()}
    assert got == brute.op10(rows)


def test_op6_finds_what_stands_word_for_word(spark):
    con = connect(FOLDER)
    planted = {r[0] for r in con.execute("SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()}
    assert {r["doc_id"] for r in result(spark, "op6_decontamination").collect()} >= planted


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_fingerprints", "op4_token_counts", "op7_source_mixing"])
def test_one_row_for_each_document(spark, rows, name):
    got = [r["doc_id"] for r in result(spark, name).collect()]
    assert sorted(got) == sorted(i for i, _ in rows)


def test_pipeline_stage_by_stage(spark, rows, tmp_path):
    """Each stage against its rule on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        texts[name] = (before, after)
        if name == "line_dedup":
            want = brute.op5(sorted(before.items()))
            assert {i: brute.sha(t or "") for i, t in after.items()} == {i: w[2] for i, w in want.items()}
        if name == "jaccard_join":
            want = brute.op10(sorted(before.items()), 5, 80)
            assert set(after) == {i for i, w in want.items() if w[1] == i}
        if name != "line_dedup":
            assert all(before[i] == t for i, t in after.items())
        if name == "source_mixing":
            assert set(after) == set(before)
        else:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert len(texts["decontamination"][1]) > 0.8 * len(texts["decontamination"][0])
    assert len(texts["toxicity"][1]) > 0.7 * len(rows)
    whole = contract.queries()["pipeline"](spark, FOLDER)
    assert {r["doc_id"] for r in whole.collect()} == set(texts["source_mixing"][1])
