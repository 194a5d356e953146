"""A few registered queries against DuckDB; the script oracle_check.py runs all of them."""

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
CORE = ("incremental_plan", "mark_delivered", "list_filter_reason", "detail_cap", "store_upsert", "funnel", "page_text",
        "list_page_rows", "qualification_clauses", "correction_replay", "priority", "criteria_issues")


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    ok, text = compare(spark, SF, name, entry_module.queries()[name], entry_module.oracle_sql()[name], duck(SF))
    assert ok, text


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
