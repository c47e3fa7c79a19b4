"""Every registered query against its oracle SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    with oracle(SF_DIR) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, connection, name):
    plan, sql = entry_module.queries()[name], entry_module.oracle_sql().get(name)
    if sql is None:
        assert plan(spark, SF_DIR).count() > 0
        return
    same, message, *_ = compare(spark, connection, plan, sql, SF_DIR)
    assert same, message


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_results_do_not_depend_on_the_number_of_partitions(spark, rows):
    names = ["index_postings", "link_match_a", "playlist_commands", "match_input"]
    before = {n: rows(entry_module.queries()[n](spark, SF_DIR)) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for name in names:
            assert rows(entry_module.queries()[name](spark, SF_DIR)) == before[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
