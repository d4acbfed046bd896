"""Every bound query against its SQL statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

FOLDER = os.environ.get("ROLECALL_TABLES", "/root/testdata/sf0.001")
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, contract.queries(), SQL, FOLDER) == ""


def test_entry_gives_ten_rows(spark):
    assert contract.entry(spark).count() == 10


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_score_policies_read_the_postings_once(spark):
    scans = lambda name: contract.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans("score_policies") == scans("title_level")
