"""Physical plans of the registered queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR


def plan_of(spark, name: str) -> str:
    return entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q05_facility_intensity", "q06_region_type_subtotals", "q10_reduction_opportunities", "p14_year_as_range"])
def test_year_filter_reaches_line_items(spark, name):
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(spark, name)


@pytest.mark.parametrize("name", ["q03_scope3_pareto", "q05_facility_intensity", "v03_facility_rankings", "w06_ranged_rank_and_quartile", "w08_w09_pareto", "r09_abatement_curve"])
def test_rankings_build_without_a_job_and_share_their_scan(spark, name):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = entry.queries()[name](spark, SF_DIR)
    assert len(tracker.getJobIdsForGroup(None)) == before
    df.collect()
    run = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # facts and revenue each once, however often the ranking reads them
    assert run.count("lineitem.parquet") <= (2 if name[:3] in ("q05", "v03") else 1)


@pytest.mark.parametrize("name", ["q01_monthly_trend", "q06_region_type_subtotals", "q07_quality_audit", "k14_latest_operations", "s03_combined_single_pass", "k19_scorecard", "w04_year_over_year_calendar", "a10_monthly_resample", "k01_summary_kpis", "a03_distinct_counts", "d01_row_rules"])
def test_line_items_are_read_once(spark, name):
    assert plan_of(spark, name).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["q01_monthly_trend", "q03_scope3_pareto", "r08_carbon_cost_by_region", "k08_intensity_trend", "f08_emission_scenarios"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan_of(spark, name)


def test_limit_plans_as_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "q10_reduction_opportunities")
    assert "WindowGroupLimit" in plan_of(spark, "t02_top_by_region")


def test_columns_are_pruned(spark):
    schema = plan_of(spark, "k12_renewable_by_month").split("ReadSchema: ")[1]
    assert "l_extendedprice" not in schema and "l_discount" in schema


def test_monthly_report_shuffles_months_only(spark):
    """Readings are summed by month before any exchange."""
    text = plan_of(spark, "q01_monthly_trend")
    assert "hashpartitioning(l_suppkey" not in text


def test_validation_builds_without_a_job(spark):
    """The line items are read for the rows and, only their keys and months, for the keys."""
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = entry.queries()["d02_failed_rule_summary"](spark, SF_DIR)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 2
