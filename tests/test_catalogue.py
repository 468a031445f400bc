"""A sample of registered queries against their SQL on the small driver tables, and the contract."""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "dfg_counts",
    "trace_variants",
    "event_log_merged",
    "json_leaves",
    "document_structure",
    "rule_counts",
    "entry_links",
    "content_relations",
    "flow_frequency",
    "business_pattern",
]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SAMPLE) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_sample_agrees_with_sql(spark):
    pytest.importorskip("duckdb")
    result = check.compare(spark, FOLDER, SAMPLE)
    assert {name: state for name, (state, _) in result.items()} == dict.fromkeys(SAMPLE, "OK")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
