from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import by, month
from scopeledger.functions.scalars import total_emissions
from scopeledger.model import lookups as L
from scopeledger.model.schemas import ANNUAL
from scopeledger.operators.joins import literal_dim
from scopeledger.plans import allocation as G
from scopeledger.plans import quality as Q

DAY = date(2021, 1, 1)


def good(f, d=DAY, **over):
    row = dict(facility_id=f, date=d, s1=1.0, loc=5.0, mkt=4.0, s3=1.0, mwh=1.0, ren=50.0) | over
    return tuple(row.values())


def test_validation_splits_rows(spark, emissions):
    rows = [
        good("a"), good("b", s1=-1.0), good("c", mkt=6.0), good("d", ren=101.0), good("e", d=date(2030, 1, 1)),
        good("ghost"), good("twice"), good("twice"), good("twice"), good("n", s3=None), good(None),
    ]
    facilities = spark.createDataFrame([(k,) for k in ["a", "b", "c", "d", "e", "twice", "n"]], "facility_id STRING")
    clean, bad, summary = Q.validate(
        emissions(rows), Q.emission_rules("2025-01-01"), ["facility_id", "date"], {"facility_id": facilities}
    )
    assert [r["facility_id"] for r in clean.collect()] == ["a"]
    reasons = {r["facility_id"]: r["failed_rules"] for r in bad.collect()}
    assert reasons["b"] == ["non_negative:scope1_tonnes"]
    assert reasons["c"] == ["market_not_above_location"]
    assert reasons["d"] == ["range:renewable_pct"]
    assert reasons["e"] == ["date_not_in_future"]
    assert reasons["ghost"] == ["reference:facility_id"]
    assert reasons["n"] == ["not_null:scope3_tonnes"]
    assert reasons[None] == ["not_null:facility_id"]
    counts = by(summary, "rule")
    assert counts["unique:facility_id,date"]["failed"] == 3 and counts["unique:facility_id,date"]["total_rows"] == 11


def test_third_of_rows_on_one_key(spark, emissions):
    rows = [good("hot", s1=float(i)) for i in range(300)] + [good(f"f{i}") for i in range(600)]
    df = emissions(rows)
    assert [(r["facility_id"], r["rows"]) for r in Q.duplicate_keys(df, ["facility_id", "date"]).collect()] == [("hot", 300)]
    kept = Q.dedupe(df, ["facility_id", "date"])
    assert kept.count() == 601 and kept.filter("facility_id = 'hot'").first()["scope1_tonnes"] == 0.0
    clean, bad, _ = Q.validate(df, [], ["facility_id", "date"])
    assert (clean.count(), bad.count()) == (600, 300)


def test_dimension_rules(spark):
    sites = spark.createDataFrame([("a", "A", "EU", "Manufacturing", 50.0, "Small"), ("b", "B", "EU", "Ship", 120.0, "Huge")],
        "facility_id STRING, facility_name STRING, region STRING, facility_type STRING, typical_renewable_pct DOUBLE, relative_size STRING")
    got = by(Q.row_summary(sites, Q.facility_rules(full=True)), "rule")
    assert [got[r]["failed"] for r in ("allowed:facility_type", "range:typical_renewable_pct", "allowed:relative_size")] == [1, 1, 1]
    targets = spark.createDataFrame([(1.0, 0.5, 2020, 2030), (1.0, 0.5, 2030, 2020)], "baseline_emissions DOUBLE, target_emissions DOUBLE, baseline_year INT, target_year INT")
    assert by(Q.row_summary(targets, Q.target_rules()), "rule")["target_after_baseline"]["failed"] == 1
    factors = literal_dim(spark, L.FACTOR_ROWS, "factor_name STRING, scope STRING, emission_factor DOUBLE, unit STRING, source STRING, geography STRING, year INT, last_updated DATE")
    assert all(r["failed"] == 0 for r in Q.row_summary(factors, Q.factor_rules()).collect())


def test_completeness(spark):
    df = spark.createDataFrame([("a", month(i)) for i in (0, 2, 3)], "k STRING, date DATE")
    got = Q.completeness(df, "date", ["k"]).first()
    assert (got["present"], got["expected"], got["missing"]) == (3, 4, 1)


# noise-free totals in tonnes, rounded
TOTALS = {2020: 9645784, 2021: 11237195, 2022: 13135204, 2023: 14781640, 2024: 15564308, 2025: 13255333}
LOCATION = {2020: 6298166, 2021: 7401684, 2022: 8756853, 2023: 10395708, 2024: 12039830}


@pytest.fixture(scope="module")
def generated(spark):
    df = G.build_dataset(spark, noise=0.0).cache()
    yield df
    df.unpersist()


def test_generated_totals(generated):
    got = generated.groupBy("year").agg(
        F.sum(total_emissions()).alias("t"), F.sum("scope2_location_tonnes").alias("loc"),
        F.sum("scope1_tonnes").alias("s1"), F.sum("scope3_tonnes").alias("s3"), F.count(F.lit(1)).alias("n"),
    )
    rows = by(got, "year")
    for year, total in TOTALS.items():
        assert rows[year]["t"] == pytest.approx(total, abs=1)
    for year, total in LOCATION.items():
        assert rows[year]["loc"] == pytest.approx(total, abs=1)
    assert rows[2020]["s1"] == pytest.approx(59950, abs=1) and rows[2020]["s3"] == pytest.approx(8201500, abs=1)
    assert sum(r["n"] for r in rows.values()) == 1400


def test_generated_operations(generated):
    row = generated.filter("facility_id = 'DC-VA-001' and date = '2022-01-01'").first()
    assert row["pue"] == pytest.approx(1.076)
    assert row["cfe_pct"] == 0.68 and row["water_consumption_gallons"] == pytest.approx(191.6 / 12 * 5565 / 8135)
    assert row["water_withdrawal_gallons"] - row["water_discharge_gallons"] == pytest.approx(row["water_consumption_gallons"])
    assert row["energy_cost_usd"] == pytest.approx(row["electricity_mwh"] * 65 / 1000)
    office = generated.filter("facility_id = 'OFF-NY-001'")
    assert office.filter("pue is not null").count() == 0


def test_verification_against_published(spark, generated):
    annual = literal_dim(spark, L.ANNUAL_ROWS, ANNUAL)
    got = by(G.verify_totals(generated, annual), "year")
    assert got[2020]["diff_pct"] == pytest.approx(10.4, abs=0.05) and got[2024]["diff_pct"] == pytest.approx(2.5, abs=0.05)


def test_noise_is_repeatable_and_bounded(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("facility_id"), F.lit(DAY).alias("date"))
    once = ids.select(G.variation().alias("v")).collect()
    assert once == ids.repartition(7).sort(F.col("facility_id").cast("long")).select(G.variation().alias("v")).collect()
    values = [r["v"] for r in once]
    assert min(values) >= 0.95 and max(values) <= 1.05 and abs(sum(values) / 1000 - 1) < 0.01


def test_targets(spark):
    annual = literal_dim(spark, L.ANNUAL_ROWS, ANNUAL)
    got = by(G.make_targets(annual, 2020, L.TARGET_CUTS), "scope")
    assert (got["Scope 1 & 2"]["baseline_emissions"], got["Scope 1 & 2"]["target_emissions"]) == (967400.0, 483700.0)
    assert (got["Scope 3"]["baseline_emissions"], got["Scope 3"]["target_emissions"]) == (7770000.0, pytest.approx(5439000.0))
    assert got["Scope 3"]["target_year"] == 2030
