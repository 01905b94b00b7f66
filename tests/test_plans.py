"""What the plans must look like whatever the data: filters and columns at the scan, no products of tables."""

import re

import pytest

from tilth.plans import catalog

SF = "/root/testdata/sf0.001"
# Products with one side of fixed size: a single count, or a list of priorities.
SMALL_PRODUCTS = {"coverage_matrix", "resume_work"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_products(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    if name not in SMALL_PRODUCTS:
        assert "BroadcastNestedLoopJoin" not in plan


def test_range_filters_reach_the_scan(spark):
    plan = plan_of(catalog.queries()["lexi_range"](spark, SF))
    assert "GreaterThanOrEqual(l_orderkey,100)" in plan and "LessThanOrEqual(l_orderkey,140)" in plan


@pytest.mark.parametrize("name, columns", [("upsert_last_wins", {"event_id", "ts", "user_id", "event_type", "value"}), ("topk_union", {"doc_id", "lang", "source", "n_chars"}), ("status_pivot", {"event_id", "ts", "user_id", "event_type", "value"})])
def test_scans_read_only_what_is_used(spark, name, columns):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(catalog.queries()[name](spark, SF))):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


def test_last_wins_combines_before_the_shuffle(spark):
    assert re.search(r"partial_max\(", plan_of(catalog.queries()["upsert_last_wins"](spark, SF)))
