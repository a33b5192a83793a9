"""Plans that must hold at any size."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry

LAZY = [
    "scan_dataset", "quality_overall", "column_stats", "contract_match", "classify_by_name", "usage_daily", "usage_stale", "catalog_detail",
    "search_boolean", "search_bm25", "audit_query", "alert_history", "emit_upsert", "quota_admission", "request_latency_quantile", "delta_log_snapshot",
    "lineage_neighbors", "glossary_links",
]


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_narrow_and_filtered(spark):
    plan = plan_of(entry.queries()["scan_dataset"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan and "l_partkey" not in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
