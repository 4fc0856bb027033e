from __future__ import annotations

from datetime import date

import pytest

from conftest import by, month
from scopeledger.plans import kpis as K
from scopeledger.plans import reports as R

FACILITIES = [
    ("a", "Alpha", "EU", "Data Center"), ("b", "Beta", "EU", "Office"), ("c", "Gamma", None, "Data Center"),
]


@pytest.fixture()
def facilities(spark):
    return spark.createDataFrame(FACILITIES, "facility_id STRING, facility_name STRING, region STRING, facility_type STRING")


@pytest.fixture()
def facts(emissions):
    rows = [
        (f, month(m), 10.0 + m, 100.0, 50.0 + m, 200.0, 1000.0, 60.0 + m % 3)
        for f in ("a", "b", "c") for m in range(36)
    ]
    return emissions(rows)


def business(spark, rows):
    return spark.createDataFrame(rows, "facility_id STRING, date DATE, revenue_millions DOUBLE, headcount INT, square_feet INT, server_count INT")


def test_yoy_filters_before_looking_back(facts):
    first = R.q02_yoy(facts, 2021).collect()
    assert len(first) == 24 and all(r["prior_year_emissions"] is None for r in first[:12])
    full = R.q02_yoy(facts, 2021, filter_first=False, mode="calendar").collect()
    assert len(full) == 24 and full[0]["absolute_change"] == 72.0


def test_intensity_drops_months_without_business_and_zero_revenue(spark, facilities, facts):
    day = date(2021, 1, 1)
    rows = [("a", day, 2.0, 1, 1, 1), ("b", day, 0.0, 1, 1, 1)]
    got = by(R.q05_intensity(facilities, facts, business(spark, rows), 2021), "facility_id")
    assert set(got) == {"a", "b"}
    assert got["a"]["emission_intensity"] == 142.0 and got["b"]["emission_intensity"] is None
    assert got["a"]["intensity_rank"] == 1 and got["a"]["performance_category"] == "Top Performer"


def test_rankings_put_missing_revenue_last(spark, facilities, facts):
    day = date(2021, 1, 1)
    rows = [("a", day, 2.0, 1, 1, 1), ("b", day, 0.0, 1, 1, 1), ("c", day, 1.0, 1, 1, 1)]
    got = by(R.v_rankings(facilities, facts, business(spark, rows), 2021), "facility_id")
    assert [got[k]["intensity_rank"] for k in "acb"] == [1, 2, 3]


def test_subtotals_equal_their_leaves(facilities, facts):
    got = R.q06_subtotals(facilities, facts, 2021).collect()
    leaves = [r for r in got if r["facility_type"] != "All Types"]
    total = next(r for r in got if r["region"] == "TOTAL")
    assert total["facility_count"] == 3
    assert total["total_emissions"] == sum(r["total_emissions"] for r in leaves)


def test_audit_counts_each_defect(emissions):
    day = date(2021, 1, 1)
    rows = [
        ("a", day, 1.0, 5.0, 4.0, 1.0, 1.0, 50.0), ("b", day, None, 5.0, 6.0, 1.0, 1.0, 101.0),
        ("c", day, -1.0, 5.0, None, None, 1.0, None), ("d", day, 1.0, 5.0, 4.0, 1.0, 1.0, 100.0),
    ]
    got = by(R.q07_audit(emissions(rows), with_scope3=True), "check_type")
    passed = {k: r["count"] for k, r in got.items()}
    assert passed == {
        "Total Records": 4, "Complete Scope 1": 3, "Complete Scope 2": 3, "Complete Scope 3": 3,
        "Valid Scope 2 Values": 3, "No Negative Values": 3, "Valid Renewable %": 3,
    }
    assert got["Complete Scope 1"]["pass_rate_pct"] == 75.0
    assert R.q07_audit(emissions(rows)).count() == 6


def test_target_trajectory(spark, facts):
    targets = spark.createDataFrame(
        [("Scope 1 & 2", 2020, 3000.0, 2030, 50.0, 1500.0, True), ("Scope 3", 2020, 8000.0, 2030, 30.0, 5600.0, True)],
        "scope STRING, baseline_year INT, baseline_emissions DOUBLE, target_year INT, reduction_percent DOUBLE, target_emissions DOUBLE, sbti_aligned BOOLEAN",
    )
    got = by(R.q04_targets(facts, targets), "year")
    assert got[2021]["trajectory"] == 2850.0
    assert got[2020]["scope12_actual"] == sum(60 + 2 * m for m in range(12)) * 3
    assert got[2020]["status"] == "On Track" and got[2022]["status"] == "Behind Target"
    assert R.q04_all_targets(facts, targets).count() == 6


def test_renewable_report(facilities, facts):
    got = by(R.q09_renewable(facts, facilities), "year", "region")
    row = got[2020, "EU"]
    assert row["facility_count"] == 2
    assert row["avoided_emissions"] == sum(50 - m for m in range(12)) * 2
    assert row["renewable_electricity_mwh"] == 12 * 2 * 1000 * 0.61


def test_opportunities_order_and_limit(facilities, facts):
    got = R.q10_opportunities(facilities, facts, 2021, k=2).collect()
    assert [r["facility_id"] for r in got] == ["a", "b"]


def test_extract_totals_agree(facilities, facts):
    monthly = by(R.x_monthly(facts), "year_month")
    regional = R.x_by_type(facilities, facts).collect()
    for key, row in monthly.items():
        assert sum(r["total_emissions"] for r in regional if r["year_month"] == key) == pytest.approx(row["total_emissions"])


def test_extract_has_seven_files(spark, facilities, facts):
    empty = business(spark, [("a", date(2021, 1, 1), 0.0, 0, 0, 0)])
    out = R.all_extracts(facilities, facts, empty, spark.range(1).selectExpr(
        "'s' scope", "1 baseline_year", "1D baseline_emissions", "2 target_year", "1D reduction_percent", "1D target_emissions", "true sbti_aligned"
    ), spark.range(1).selectExpr("1 category_id", "'c' category_name", "'d' description", "1D typical_pct_of_scope3"))
    assert len(out) == 7
    row = by(out["emissions_data"], "facility_id", "date")["a", date(2021, 1, 1)]
    assert row["intensity_per_revenue"] is None and row["intensity_per_employee"] is None


def test_regional_kpi_reports_rows_without_region(facilities, facts):
    got = K.k07_regional(facts, facilities, 2021).collect()
    assert [r["region"] for r in got] == ["EU"]
    assert got[0]["rows_without_region"] == 12 and got[0]["row_count"] == 24 and got[0]["facility_count"] == 2


def test_latest_year_change_is_zero_without_a_prior_year(emissions):
    rows = [("a", month(m), 1.0, 1.0, 1.0, 1.0, 1.0, 50.0) for m in range(12)]
    assert K.k03_latest_year(emissions(rows)).first()["yoy_pct"] == 0.0


def test_summary_keeps_row_when_prior_year_is_missing(spark, emissions):
    ops = spark.createDataFrame([(None, 0.5, 0.1, 0.8), (1.1, 0.7, 0.3, 0.9)], "pue DOUBLE, cfe_pct DOUBLE, water_replenishment_pct DOUBLE, waste_diversion_pct DOUBLE")
    rows = [("a", month(0), 1.0, 1.0, 1.0, 1.0, 1.0, 50.0)]
    got = K.k01_summary(emissions(rows), ops).first()
    assert got["yoy_pct"] is None and got["avg_cfe"] == pytest.approx(0.7)


def test_scorecard_values(spark):
    rows = [("a", "Data Center", date(2024, 1, 1), 1.09, 0.7, 0.6, 0.85, 100.0, 2.0), ("b", "Office", date(2024, 1, 1), None, 0.1, 0.1, 0.1, 1.0, 1.0)]
    combined = spark.createDataFrame(
        rows, "facility_id STRING, facility_type STRING, date DATE, pue DOUBLE, cfe_pct DOUBLE, water_replenishment_pct DOUBLE, "
        "waste_diversion_pct DOUBLE, water_consumption_gallons DOUBLE, electricity_mwh DOUBLE",
    )
    got = K.k19_scorecard(combined).first()
    assert got["pue_score"] == pytest.approx(82.0)
    assert got["water_score"] == pytest.approx(75.0)
    assert got["overall_score"] == pytest.approx((82 + 70 + 60 + 75 + 85) / 5) and got["band"] == "strong"
    kinds = {(r["kind"], r["area"]) for r in K.k20_strengths(combined).collect()}
    assert kinds == {("strength", "pue"), ("strength", "waste_diversion")}
    assert K.k19_scorecard(combined.filter("facility_type = 'Office'")).count() == 0
