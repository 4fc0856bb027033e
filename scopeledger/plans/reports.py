"""The analytical reports, views and extracts.

Facts are reduced to facility or month grain before a dimension is joined, so a
join moves at most one row per facility and period, and distinct facility
counts become plain counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.functions.aggregates import count_where, mean, scope_sums
from scopeledger.functions.scalars import (
    label, month_of, round_half_up, round_ratio, safe_div, total_emissions, year_month, year_of,
)
from scopeledger.operators import aggregates as A
from scopeledger.operators import windows as Wn
from scopeledger.operators.filters import in_year, year_range
from scopeledger.operators.joins import allocate_by_share, enrich, scenario_grid
from scopeledger.operators.ranking import pareto, rank_quartile, with_order_stats
from scopeledger.operators.reshape import stack_rows
from scopeledger.operators.topk import latest_n, top_k

QUARTILE_LABELS = ["Top Performer", "Above Average", "Below Average", "Needs Improvement"]
SITE = ["facility_id", "facility_name", "region", "facility_type"]


def _by_month(emissions: DataFrame) -> DataFrame:
    return emissions.groupBy("date").agg(F.sum(total_emissions()).alias("total_emissions"))


def q01_trend(emissions: DataFrame, latest: int = 24) -> DataFrame:
    """Monthly scope totals with 3- and 6-month moving averages, newest first."""
    monthly = A.scope_totals(emissions, [year_month("date").alias("month")])
    monthly = Wn.moving_average(monthly, "total", "month", 2, out="moving_avg_3m")
    monthly = Wn.moving_average(monthly, "total", "month", 5, out="moving_avg_6m")
    shown = ["scope1", "scope2", "scope3", "total", "moving_avg_3m", "moving_avg_6m"]
    return latest_n(monthly, "month", latest).select("month", *[round_half_up(c).alias(c) for c in shown])


def q02_yoy(emissions: DataFrame, from_year: int, filter_first: bool = True, mode: str = "rows") -> DataFrame:
    """Month against the same month a year before.

    ``filter_first`` drops earlier years before looking back, which leaves the
    first twelve months without a prior value; otherwise they are looked up.
    """
    source = year_range(emissions, from_year if filter_first else from_year - 1)
    monthly = _by_month(source)
    yoy = Wn.period_change(monthly, "total_emissions", "date", 12, mode=mode)
    if not filter_first:
        yoy = year_range(yoy, from_year)
    return yoy.select(
        year_of("date").alias("year"), month_of("date").alias("month"),
        round_half_up("total_emissions").alias("current_emissions"),
        round_half_up("prior_total_emissions").alias("prior_year_emissions"),
        round_half_up("change").alias("absolute_change"),
        round_half_up("pct_change", 1).alias("pct_change"),
    ).orderBy("year", "month")


def q03_pareto(emissions: DataFrame, categories: DataFrame, year: int) -> DataFrame:
    """Scope 3 split by category share, ranked, with cumulative percent."""
    total = in_year(emissions, year).agg(F.sum("scope3_tonnes").alias("scope3"))
    share = F.col("typical_pct_of_scope3").cast("double") / 100
    split = allocate_by_share(total, "scope3", categories, share, "estimated_tonnes")
    split = split.withColumn("estimated_tonnes", round_half_up("estimated_tonnes"))
    ranked = pareto(split, "estimated_tonnes", ["category_id"])
    return ranked.select(
        "category_id", "category_name", "description", "estimated_tonnes", "rank",
        round_half_up("share_pct", 1).alias("pct_of_scope3"),
        round_half_up("cumulative_pct", 1).alias("cumulative_pct"),
    ).orderBy(F.col("estimated_tonnes").desc(), "category_id")


def _trajectory(year: Column) -> Column:
    """Linear path from baseline to target."""
    span = F.col("target_year") - F.col("baseline_year")
    step = (F.col("baseline_emissions") - F.col("target_emissions")) * (year - F.col("baseline_year")) / span
    return F.col("baseline_emissions") - step


def q04_targets(emissions: DataFrame, targets: DataFrame, scope: str = "Scope 1 & 2") -> DataFrame:
    """Yearly actuals against the linear target trajectory of one scope."""
    tracked = "scope3_total" if scope == "Scope 3" else "scope12_total"
    annual = emissions.groupBy(year_of("date").alias("year")).agg(
        F.sum(F.col("scope1_tonnes") + F.col("scope2_market_tonnes")).alias("scope12_total"),
        F.sum("scope3_tonnes").alias("scope3_total"),
    )
    annual = annual.withColumn("total", F.col("scope12_total") + F.col("scope3_total"))
    paired = scenario_grid(annual, targets.filter(F.col("scope") == scope))
    actual, path = F.col(tracked).cast("double"), _trajectory(F.col("year"))
    progress = safe_div(
        F.col("baseline_emissions") - actual, F.col("baseline_emissions") - F.col("target_emissions")
    ) * 100
    return paired.filter(F.col("year") >= F.col("baseline_year")).select(
        "year",
        round_half_up("scope12_total").alias("scope12_actual"),
        round_half_up("scope3_total").alias("scope3_actual"),
        round_half_up("total").alias("total_actual"),
        round_half_up("baseline_emissions").alias("baseline"),
        round_half_up("target_emissions").alias("target"),
        round_half_up(path).alias("trajectory"),
        round_half_up(progress, 1).alias("pct_progress"),
        label([(actual <= path, "On Track")], "Behind Target").alias("status"),
    ).orderBy("year")


def q04_all_targets(emissions: DataFrame, targets: DataFrame) -> DataFrame:
    """The same tracking for every target row, whatever scope it names."""
    annual = emissions.groupBy(year_of("date").alias("year")).agg(
        F.sum(F.col("scope1_tonnes") + F.col("scope2_market_tonnes")).alias("Scope 1 & 2"),
        F.sum("scope3_tonnes").alias("Scope 3"),
    )
    long = annual.unpivot(["year"], ["Scope 1 & 2", "Scope 3"], "scope", "actual_tonnes")
    actual, path = F.col("actual_tonnes").cast("double"), _trajectory(F.col("year"))
    return long.join(F.broadcast(targets), "scope").filter(F.col("year") >= F.col("baseline_year")).select(
        "scope", "year", round_half_up("actual_tonnes").alias("actual"),
        round_half_up(path).alias("trajectory"),
        label([(actual <= path, "On Track")], "Behind Target").alias("status"),
    ).orderBy("scope", "year")


def _facility_intensity(emissions: DataFrame, business: DataFrame) -> DataFrame:
    """Totals per facility over the months that have business figures."""
    months = enrich(
        emissions.select("facility_id", "date", total_emissions().alias("t"), "renewable_pct"),
        business.select("facility_id", "date", "revenue_millions"),
        ["facility_id", "date"],
    )
    return months.groupBy("facility_id").agg(
        F.sum("t").alias("total_emissions"),
        F.sum("revenue_millions").alias("total_revenue"),
        mean("renewable_pct").alias("avg_renewable_pct"),
    )


def q05_intensity(facilities: DataFrame, emissions: DataFrame, business: DataFrame, year: int) -> DataFrame:
    """Facilities ranked by emissions per revenue, with quartiles."""
    per_site = _facility_intensity(in_year(emissions, year), in_year(business, year))
    per_site = per_site.withColumn(
        "emission_intensity", round_half_up(safe_div("total_emissions", "total_revenue"), 1)
    )
    named = enrich(per_site, facilities.select(*SITE), "facility_id")
    ranked = rank_quartile(named, "emission_intensity", ["facility_id"])
    cases = [(F.col("quartile") == i + 1, text) for i, text in enumerate(QUARTILE_LABELS[:-1])]
    return ranked.select(
        *SITE,
        round_half_up("total_emissions").alias("total_emissions"),
        round_half_up("total_revenue", 1).alias("total_revenue"),
        "emission_intensity",
        round_half_up("avg_renewable_pct").alias("avg_renewable_pct"),
        F.col("rank").alias("intensity_rank"),
        F.col("quartile").alias("performance_quartile"),
        label(cases, QUARTILE_LABELS[-1]).alias("performance_category"),
    ).orderBy("emission_intensity", "facility_id")


def q06_subtotals(facilities: DataFrame, emissions: DataFrame, year: int) -> DataFrame:
    """Region by type with subtotals and grand total from one pass."""
    per_site = A.scope_totals(in_year(emissions, year), ["facility_id"])
    named = enrich(per_site, facilities.select(*SITE), "facility_id")
    measures = [F.count(F.lit(1)).alias("facility_count")] + [
        round_half_up(F.sum(src)).alias(out)
        for src, out in [
            ("scope1", "scope1_total"), ("scope2", "scope2_total"),
            ("scope3", "scope3_total"), ("total", "total_emissions"),
        ]
    ]
    report = A.rollup_report(named, ["region", "facility_type"], measures)
    return A.totals_last(report.drop("level"), ["region", "facility_type"])


def q07_audit(emissions: DataFrame, with_scope3: bool = False) -> DataFrame:
    """Completeness and validity checks with pass rates, from one aggregate row."""
    negative = (F.col("scope1_tonnes") < 0) | (F.col("scope2_market_tonnes") < 0) | (F.col("scope3_tonnes") < 0)
    renewable = F.col("renewable_pct")
    failed = [
        ("Total Records", F.lit(False)),
        ("Complete Scope 1", F.col("scope1_tonnes").isNull()),
        ("Complete Scope 2", F.col("scope2_market_tonnes").isNull()),
        ("Valid Scope 2 Values", F.col("scope2_market_tonnes") > F.col("scope2_location_tonnes")),
        ("No Negative Values", negative),
        ("Valid Renewable %", (renewable < 0) | (renewable > 100)),
    ]
    if with_scope3:
        failed.insert(3, ("Complete Scope 3", F.col("scope3_tonnes").isNull()))
    counts = [count_where(c).alias(f"f{i}") for i, (_, c) in enumerate(failed)]
    one = emissions.agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = []
    for i, (text, _) in enumerate(failed):
        passed = F.col("n") - F.col(f"f{i}")
        rows.append([F.lit(text), passed, round_half_up(safe_div(passed * 100.0, "n"), 2)])
    return stack_rows(one, [], ["check_type", "count", "pass_rate_pct"], rows)


def q08_decompose(emissions: DataFrame, n: int = 24) -> DataFrame:
    """Trend, seasonal and residual parts of the monthly total, newest first."""
    parts = Wn.decompose(_by_month(emissions), "total_emissions", "date")
    return latest_n(parts, "date", n).select(
        "date",
        round_half_up("total_emissions").alias("actual"),
        round_half_up("trend").alias("trend_component"),
        round_half_up("seasonal").alias("seasonal_component"),
        round_half_up("detrended").alias("detrended"),
        round_half_up("residual").alias("residual"),
        "trend_direction",
    )


def q09_renewable(emissions: DataFrame, facilities: DataFrame) -> DataFrame:
    """Avoided emissions and renewable electricity by year and region."""
    year = year_of("date").alias("year")
    per_site = emissions.groupBy("facility_id", year).agg(
        F.sum("renewable_pct").alias("pct_sum"), F.count("renewable_pct").alias("pct_n"),
        F.sum("scope2_location_tonnes").alias("loc"), F.sum("scope2_market_tonnes").alias("mkt"),
        F.sum("electricity_mwh").alias("mwh"),
        F.sum(F.col("electricity_mwh") * F.col("renewable_pct")).alias("ren"),
    )
    named = enrich(per_site, facilities.select("facility_id", "region"), "facility_id")
    out = named.groupBy("year", "region").agg(
        F.count(F.lit(1)).alias("facility_count"),
        safe_div(F.sum("pct_sum"), F.sum("pct_n")).alias("avg_pct"),
        F.sum("loc").alias("loc"), F.sum("mkt").alias("mkt"), F.sum("mwh").alias("mwh"), F.sum("ren").alias("ren"),
    )
    avoided = F.col("loc") - F.col("mkt")
    return out.select(
        "year", "region", "facility_count",
        round_half_up("avg_pct", 1).alias("avg_renewable_pct"),
        round_half_up("loc").alias("scope2_location_total"),
        round_half_up("mkt").alias("scope2_market_total"),
        round_half_up(avoided).alias("avoided_emissions"),
        round_half_up(safe_div(avoided, "loc") * 100, 1).alias("avoided_emissions_pct"),
        round_half_up("mwh").alias("total_electricity_mwh"),
        round_half_up(F.col("ren").cast("double") / 100).alias("renewable_electricity_mwh"),
    ).orderBy(F.col("year").desc(), "region")


def q10_opportunities(facilities: DataFrame, emissions: DataFrame, year: int, k: int = 10) -> DataFrame:
    """Facilities with the largest reduction potential."""
    sums = in_year(emissions, year).groupBy("facility_id").agg(
        F.sum(total_emissions()).cast("double").alias("total"),
        F.sum(F.col("scope2_location_tonnes") - F.col("scope2_market_tonnes")).cast("double").alias("impact"),
        (F.sum("scope2_location_tonnes").cast("double") * 0.50).alias("possible"),
        mean("renewable_pct").alias("pct"),
        (F.sum("scope1_tonnes").cast("double") * 0.20).alias("s1"),
        (F.sum("scope3_tonnes").cast("double") * 0.30).alias("s3"),
    )
    renewable = F.col("possible") - F.col("impact")
    potential = renewable + F.col("s1") + F.col("s3")
    named = enrich(sums, facilities.select(*SITE), "facility_id")
    scored = named.select(
        *SITE,
        round_half_up("total").alias("current_emissions"),
        round_half_up("pct").alias("current_renewable_pct"),
        round_half_up(renewable).alias("renewable_opportunity"),
        round_half_up("s1").alias("scope1_opportunity"),
        round_half_up("s3").alias("scope3_opportunity"),
        round_half_up(potential).alias("total_opportunity"),
        round_half_up(safe_div(potential, "total") * 100, 1).alias("potential_reduction_pct"),
    )
    return top_k(scored, "total_opportunity", ["facility_id"], k)


# -- views ----------------------------------------------------------------


def v_monthly(facilities: DataFrame, emissions: DataFrame, business: DataFrame) -> DataFrame:
    """Facility-months with totals and revenue intensity."""
    months = enrich(emissions, business.select("facility_id", "date", "revenue_millions"), ["facility_id", "date"], "left")
    months = enrich(months, facilities.select(*SITE), "facility_id")
    revenue = F.col("revenue_millions")
    return months.select(
        *SITE, "date", year_of("date").alias("year"), year_month("date").alias("month"),
        "scope1_tonnes", "scope2_location_tonnes", "scope2_market_tonnes", "scope3_tonnes",
        total_emissions().alias("total_emissions"), "renewable_pct", "revenue_millions",
        F.when(revenue > 0, safe_div(total_emissions(), revenue)).alias("emission_intensity"),
    )


def v_annual(emissions: DataFrame) -> DataFrame:
    """Yearly totals. Facilities are counted after reducing to one row per facility and year."""
    year = year_of("date").alias("year")
    per_site = emissions.groupBy(year, "facility_id").agg(
        *scope_sums(), F.sum("scope2_location_tonnes").alias("location"),
        F.sum("renewable_pct").alias("pct_sum"), F.count("renewable_pct").alias("pct_n"),
    )
    return per_site.groupBy("year").agg(
        F.count("facility_id").alias("facility_count"),
        F.sum("scope1").alias("total_scope1"),
        F.sum("location").alias("total_scope2_location"),
        F.sum("scope2").alias("total_scope2_market"),
        F.sum("scope3").alias("total_scope3"),
        F.sum("total").alias("total_emissions"),
        safe_div(F.sum("pct_sum"), F.sum("pct_n")).alias("avg_renewable_pct"),
    ).orderBy("year")


def v_rankings(facilities: DataFrame, emissions: DataFrame, business: DataFrame, as_of_year: int) -> DataFrame:
    """Facilities of one year by intensity; those without revenue rank last together."""
    per_site = _facility_intensity(in_year(emissions, as_of_year), in_year(business, as_of_year))
    per_site = per_site.withColumn(
        "emission_intensity",
        F.when(F.col("total_revenue") > 0, safe_div("total_emissions", "total_revenue")),
    )
    named = enrich(per_site, facilities.select(*SITE), "facility_id")
    ranked = with_order_stats(named, "emission_intensity", ["facility_id"])
    return ranked.select(
        *SITE, "total_emissions", "total_revenue", "emission_intensity", "avg_renewable_pct",
        F.col("rank").alias("intensity_rank"),
    ).orderBy("intensity_rank", "facility_id")


# -- extracts -------------------------------------------------------------


def x_emissions(facilities: DataFrame, emissions: DataFrame, business: DataFrame) -> DataFrame:
    """Full fact with calendar fields and intensities per revenue and per head."""
    wanted = ["revenue_millions", "headcount", "square_feet", "server_count"]
    months = enrich(emissions, business.select("facility_id", "date", *wanted), ["facility_id", "date"], "left")
    months = enrich(months, facilities.select(*SITE), "facility_id")
    return months.select(
        "date", *SITE, "scope1_tonnes", "scope2_location_tonnes", "scope2_market_tonnes", "scope3_tonnes",
        total_emissions().alias("total_emissions"), "electricity_mwh", "renewable_pct",
        year_of("date").alias("year"), month_of("date").alias("month"), year_month("date").alias("year_month"),
        *wanted,
        round_ratio(total_emissions(), "revenue_millions", 2).alias("intensity_per_revenue"),
        round_ratio(total_emissions(), "headcount", 2).alias("intensity_per_employee"),
    )


def x_facilities(facilities: DataFrame) -> DataFrame:
    extra = [c for c in ["operational_start_date"] if c in facilities.columns]
    return facilities.select(*SITE, *extra).orderBy("facility_name")


def x_targets(targets: DataFrame) -> DataFrame:
    return targets.select(
        "scope", "baseline_year", "baseline_emissions", "target_year",
        "reduction_percent", "target_emissions", "sbti_aligned",
    )


def x_categories(categories: DataFrame) -> DataFrame:
    return categories.select("category_id", "category_name", "description", "typical_pct_of_scope3")


def x_monthly(emissions: DataFrame) -> DataFrame:
    """Monthly summary over all facilities."""
    out = emissions.groupBy("date").agg(
        F.count_distinct("facility_id").alias("facilities_reporting"),
        *scope_sums("total_scope1", "total_scope2", "total_scope3", "total_emissions"),
        F.sum("electricity_mwh").alias("total_electricity"),
        mean("renewable_pct").alias("avg_renewable_pct"),
    )
    return out.select(
        year_month("date").alias("year_month"), year_of("date").alias("year"), month_of("date").alias("month"),
        *[c for c in out.columns if c != "date"],
    ).orderBy("year_month")


def _by_dimension_month(facilities: DataFrame, emissions: DataFrame, dim: str) -> DataFrame:
    months = A.scope_totals(emissions, ["facility_id", year_month("date").alias("year_month")])
    named = enrich(months, facilities.select("facility_id", dim), "facility_id")
    return named.groupBy(dim, "year_month").agg(
        F.count(F.lit(1)).alias("facilities"),
        F.sum("scope1").alias("scope1"), F.sum("scope2").alias("scope2"),
        F.sum("scope3").alias("scope3"), F.sum("total").alias("total_emissions"),
    ).orderBy("year_month", dim)


def x_regional(facilities: DataFrame, emissions: DataFrame) -> DataFrame:
    return _by_dimension_month(facilities, emissions, "region")


def x_by_type(facilities: DataFrame, emissions: DataFrame) -> DataFrame:
    return _by_dimension_month(facilities, emissions, "facility_type")


def all_extracts(
    facilities: DataFrame, emissions: DataFrame, business: DataFrame, targets: DataFrame, categories: DataFrame
) -> dict[str, DataFrame]:
    """The seven extracts by file name."""
    return {
        "emissions_data": x_emissions(facilities, emissions, business),
        "facilities": x_facilities(facilities),
        "emission_targets": x_targets(targets),
        "scope3_categories": x_categories(categories),
        "monthly_summary": x_monthly(emissions),
        "regional_summary": x_regional(facilities, emissions),
        "facility_type_summary": x_by_type(facilities, emissions),
    }
