"""Annual totals to monthly facility records, derived operations, costs and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.scalars import pct_change, total_emissions, year_of
from scopeledger.model import lookups as L
from scopeledger.operators.aggregates import with_group_size
from scopeledger.operators.calendar import month_spine
from scopeledger.operators.joins import literal_dim, lookup

SPREAD = ["scope1", "scope2_location", "scope2_market", "scope3", "electricity", "fuel", "water", "waste"]
ENERGY_SEASONAL = ["scope2_location", "scope2_market", "electricity"]


def interpolate_annual(annual: DataFrame, spine: DataFrame, cols: Sequence[str] = tuple(SPREAD)) -> DataFrame:
    """Monthly values sliding linearly from one year's level to the next; the last year stays flat."""
    following = W.orderBy("year")
    ahead = [F.lead(c).over(following).alias(f"_next_{c}") for c in cols]
    levels = annual.select("*", F.lead("year").over(following).alias("_next_year"), *ahead)
    months = spine.select("date", year_of("date").alias("year"))
    t = (F.month("date") - 1) / F.lit(11.0)
    joined = months.join(F.broadcast(levels), "year")
    steady = [c for c in annual.columns if c not in cols and c != "year"]

    def slide(c: str) -> Column:
        adjacent = F.col("_next_year") == F.col("year") + 1
        goal = F.when(adjacent, F.col(f"_next_{c}")).otherwise(F.col(c))
        return ((F.col(c) + (goal - F.col(c)) * t) / 12).alias(c)

    return joined.select("date", "year", *[slide(c) for c in cols], *steady)


def seasonal_factor(which: str) -> Column:
    i = 0 if which == "energy" else 1
    month = F.month("date")
    return (
        F.when(month.isin(L.SUMMER_MONTHS), L.SUMMER_FACTORS[i])
        .when(month.isin(L.WINTER_MONTHS), L.WINTER_FACTORS[i])
        .otherwise(1.0)
    )


def seasonal(df: DataFrame) -> DataFrame:
    """Summer and winter uplift on scope 2, electricity and water."""
    present = [c for c in ENERGY_SEASONAL if c in df.columns]
    out = df.withColumns({c: F.col(c) * seasonal_factor("energy") for c in present})
    return out.withColumn("water", F.col("water") * seasonal_factor("water")) if "water" in df.columns else out


def variation(amplitude: float = 0.05) -> Column:
    """Repeatable ±amplitude noise: the first 32 bits of a digest of facility and month, which any engine can compute."""
    digest = F.md5(F.concat_ws("|", F.col("facility_id").cast("string"), F.date_format("date", "yyyy-MM-dd")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return F.lit(1 - amplitude) + F.lit(2 * amplitude) * unit


def allocate(
    monthly: DataFrame, facilities: DataFrame, shares: DataFrame, cols: Sequence[str] = tuple(SPREAD), noise: float = 0.05
) -> DataFrame:
    """Split monthly totals over facilities: type share divided by the facilities of that type."""
    sites = with_group_size(facilities, ["facility_type"]).join(F.broadcast(shares), "facility_type")
    # months are few (the calendar bounds them), facilities are not
    grid = sites.crossJoin(F.broadcast(monthly))
    fraction = F.col("share") / F.col("group_size") * (variation(noise) if noise else F.lit(1.0))
    return grid.withColumns({c: F.col(c) * fraction for c in cols}).drop("share", "group_size")


def derive_operations(
    records: DataFrame, sites: DataFrame, regions: DataFrame, annual: DataFrame, noise: float = 0.05,
    reference_year: int = L.REFERENCE_YEAR,
) -> DataFrame:
    """PUE, CFE, water and waste of every facility-month.

    ``sites`` holds (facility_id, water_2024, pue_2024) for metered data centres,
    as measured in ``reference_year``.
    """
    base = annual.filter(F.col("year") == reference_year).select(F.col("water").alias("_base_water"))
    levels = annual.select("year", F.col("water").alias("_year_water")).crossJoin(base)
    df = records.join(sites, "facility_id", "left").join(F.broadcast(levels), "year")
    df = lookup(df, regions, "region", "cfe_share", L.REGION_DEFAULTS["cfe_share"])
    metered = (F.col("facility_type") == "Data Center") & F.col("water_2024").isNotNull()
    scaled = F.col("water_2024") / 12 * F.col("_year_water") / F.col("_base_water") * (
        variation(noise) if noise else F.lit(1.0)
    )
    water = F.when(metered, scaled).otherwise(F.col("water"))
    df = df.withColumn("water", water)
    withdrawn = F.col("water") * float(L.WITHDRAWAL_RATIO)
    return df.select(
        "facility_id", "facility_name", "region", "facility_type", "date", "year",
        F.col("scope1").alias("scope1_tonnes"),
        F.col("scope2_location").alias("scope2_location_tonnes"),
        F.col("scope2_market").alias("scope2_market_tonnes"),
        F.col("scope3").alias("scope3_tonnes"),
        F.col("electricity").alias("electricity_mwh"),
        F.lit(100.0).alias("renewable_pct"),
        F.col("fuel").alias("fuel_consumption_mwh"),
        F.col("electricity").alias("renewable_electricity_mwh"),
        F.col("cfe_share").cast("double").alias("cfe_pct"),
        F.when(
            F.col("facility_type") == "Data Center",
            F.col("pue_2024") + (F.col("year") - reference_year) * L.PUE_STEP_PER_YEAR,
        ).alias("pue"),
        withdrawn.alias("water_withdrawal_gallons"),
        (withdrawn - F.col("water")).alias("water_discharge_gallons"),
        F.col("water").alias("water_consumption_gallons"),
        F.col("replenishment_pct").alias("water_replenishment_pct"),
        F.col("waste").alias("waste_generated_tons"),
        (F.col("waste") * F.col("diversion_pct")).alias("waste_diverted_tons"),
        F.col("diversion_pct").alias("waste_diversion_pct"),
    )


def derive_costs(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Energy, water and carbon cost in thousands at regional prices."""
    for name in ("energy_price", "water_price", "carbon_price"):
        df = lookup(df, prices, "region", name, L.REGION_DEFAULTS[name])
    carbon = F.col("scope1_tonnes") + F.col("scope2_market_tonnes")

    def thousands(units: Column, price: str) -> Column:
        return units.cast("double") * F.col(price).cast("double") / 1000

    return df.withColumns({
        "energy_cost_usd": thousands(F.col("electricity_mwh"), "energy_price"),
        "water_cost_usd": thousands(F.col("water_consumption_gallons"), "water_price"),
        "carbon_cost_usd": thousands(carbon, "carbon_price"),
    }).drop("energy_price", "water_price", "carbon_price")


def make_targets(
    annual: DataFrame, year: int, cuts: Sequence[tuple[str, float]], horizon: int = L.TARGET_HORIZON
) -> DataFrame:
    """Reduction targets against the totals of the baseline year."""
    base = annual.filter(F.col("year") == year).select(
        F.inline(F.array(
            F.struct(F.lit("Scope 1 & 2").alias("scope"), (F.col("scope1") + F.col("scope2_market")).alias("baseline_emissions")),
            F.struct(F.lit("Scope 3").alias("scope"), F.col("scope3").alias("baseline_emissions")),
        ))
    )
    percents = literal_dim(annual.sparkSession, cuts, "scope STRING, reduction_percent DOUBLE")
    return base.join(F.broadcast(percents), "scope").select(
        "scope", F.lit(year).alias("baseline_year"), "baseline_emissions",
        F.lit(year + horizon).alias("target_year"), "reduction_percent",
        (F.col("baseline_emissions") * (1 - F.col("reduction_percent") / 100)).alias("target_emissions"),
        F.lit(True).alias("sbti_aligned"),
    )


def verify_totals(df: DataFrame, published: DataFrame) -> DataFrame:
    """Yearly totals against published ones, with the absolute percent difference."""
    sums = df.groupBy(year_of("date").alias("year")).agg(F.sum(total_emissions()).cast("double").alias("generated"))
    return sums.join(F.broadcast(published.select("year", F.col("total").alias("published"))), "year").select(
        "year", F.round("generated", 0).alias("generated"), "published",
        F.abs(pct_change("generated", "published")).alias("diff_pct"),
    )


def build_dataset(
    spark: SparkSession, start: str = "2020-01-01", end: str = "2025-10-31", noise: float = 0.05
) -> DataFrame:
    """The full generated fact (emissions, operations and costs) from the fixed annual totals."""
    from scopeledger.model.schemas import ANNUAL

    annual = literal_dim(spark, L.ANNUAL_ROWS, ANNUAL)
    sites = literal_dim(spark, L.FACILITY_ROWS, "facility_id STRING, facility_name STRING, region STRING, facility_type STRING")
    shares = literal_dim(spark, L.TYPE_SHARES, "facility_type STRING, share DOUBLE")
    metered = literal_dim(spark, L.SITE_2024_ROWS, "facility_id STRING, water_2024 DOUBLE, pue_2024 DOUBLE")
    regions = literal_dim(spark, L.REGION_ROWS, L.REGION_SCHEMA)
    monthly = seasonal(interpolate_annual(annual, month_spine(spark, start, end)))
    records = allocate(monthly, sites, shares, noise=noise)
    return derive_costs(derive_operations(records, metered, regions, annual, noise), regions)
