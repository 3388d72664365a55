"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from twinledger.catalog import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    query, sql = QUERIES[name]
    frame = query(spark, SF_DIR)
    if sql is None:
        frame.collect()
    else:
        assert compare(frame, duck, sql) is None


def test_known_numbers_at_sf001(spark):
    """Counts fixed in advance for the orders pair."""
    summary = QUERIES["recon_summary"][0](spark, "/root/testdata/sf0.01").head()
    assert (summary["source_count"], summary["target_count"]) == (15_000, 15_014)
    assert (summary["missing_in_source"], summary["missing_in_target"]) == (169, 155)
    assert (summary["mismatched_rows_exact"], summary["found_in_both"], summary["matching_rows"]) == (
        2_156,
        14_845,
        12_689,
    )
    ruled = QUERIES["recon_summary_rules"][0](spark, "/root/testdata/sf0.01").head()
    assert (ruled["mismatched_rows"], ruled["matching_rows"]) == (981, 13_864)
