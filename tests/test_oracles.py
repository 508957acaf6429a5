"""Every registered query against its SQL.

``QUIETLOG_SF`` picks the scale (0.001 by default).  Topic deletion does not occur at
the smallest scale, so the queries about it also run at 0.01.
"""

import os

import pytest

import __spark_entry__ as contract
from quietlog.workload import oracles, registry
from tests import compare

SF = os.environ.get("QUIETLOG_SF", "0.001")
QUERIES = registry.queries()
SQL = oracles.sql()
DELETIONS = ["topic_epochs", "state_as_of_scan_with_deletions", "last_change_incremental", "deleted_topics",
             "scan_cycle_records", "changelog_encode_replay", "changelog_merge", "stream_scan"]
STREAMS = [name for name in QUERIES if name.startswith("stream_")]


def check(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    if not os.path.isdir(sf_dir):
        pytest.skip(f"no test data at {sf_dir}")
    assert compare.differences(QUERIES[name](spark, sf_dir), compare.connect(sf_dir), SQL[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in STREAMS])
def test_query(spark, name):
    check(spark, name, SF)


@pytest.mark.parametrize("name", DELETIONS)
def test_query_with_deletions(spark, name):
    check(spark, name, "0.01")


@pytest.mark.parametrize("name", STREAMS)
def test_stream(spark, name):
    check(spark, name, SF)


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0
    assert frame.columns[0] == "name"
