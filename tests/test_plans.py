"""Plan-shape regression tests: the scale properties of every registered query."""

import re

import pytest

from basketlens.catalog import queries
from tests.conftest import SF001

FORBIDDEN = {
    "python UDF": r"BatchEvalPython|ArrowEvalPython",
    "cartesian product": r"CartesianProduct",
    "exact percentile (one buffer per group)": r"\bpercentile\(",
    "Expand (rows copied per distinct aggregate)": r"\bExpand\b",
    # One-row relations enter as scalar subqueries, never as cross joins.
    "nested-loop / cross join": r"BroadcastNestedLoopJoin|\bCross\b",
}


def _plan(spark, name):
    return queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # whole lists of pushed filters
    try:
        return {n: _plan(spark, n) for n in queries() if n != "export_report"}
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_no_forbidden_operators(plans):
    for name, plan in plans.items():
        for what, pat in FORBIDDEN.items():
            assert not re.search(pat, plan), f"{name}: {what}"


def test_per_order_windows_are_in_ranges(plans):
    for name, plan in plans.items():
        for spec in re.findall(r"lead\(order_ts[^\]]*?windowspecdefinition\(([^)]*)", plan):
            assert "_part" in spec, f"{name}: per-order LEAD not inside (range, user): {spec}"


@pytest.mark.parametrize("name", ["launch_impact", "prepost_baseline_rollup_first", "order_totals_by_date", "experiment_readout", "items_in_window"])
def test_filters_reach_the_scans(spark, plans, name):
    pushed = " ".join(re.findall(r"PushedFilters: \[([^\]]*)", plans[name]))
    assert "EqualTo(o_orderstatus,F)" in pushed and "l_returnflag" in pushed
    if name != "prepost_baseline_rollup_first":  # rolled up over all history by definition
        assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    if name == "experiment_readout":
        assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_top_k_limits_before_the_shuffle(plans):
    plan = plans["first_orders"]
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)


def test_churn_windows_run_over_rollups(plans):
    for name in ("churn_vs_revenue", "churn_90d_windowed", "churn_90d_floor_days", "session_churn_1d"):
        assert "lead(first_t" in plans[name], name
        assert "lead(order_ts" not in plans[name], name
