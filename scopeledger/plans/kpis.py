"""Dashboard figures as lazy relations: one-row KPIs, trends, scorecards, insight rows.

Each figure is aggregated by period first and the period picked afterwards, so
the fact is read once. ``combined`` is the joined emissions and operations
relation of :func:`scopeledger.sources.loaders.load_combined`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.aggregates import mean, mean_of_ratios, ratio_of_sums, scope_sums
from scopeledger.functions.scalars import (
    clamp, label, named_band, pct_change, safe_div, total_emissions, year_month, year_of,
)
from scopeledger.model import lookups as L
from scopeledger.operators import aggregates as A
from scopeledger.operators import windows as Wn
from scopeledger.operators.calendar import resample_monthly
from scopeledger.operators.filters import in_year, require, year_range
from scopeledger.operators.joins import allocate_by_share, enrich, with_constant_row
from scopeledger.operators.reshape import stack_rows, unpivot_report
from scopeledger.operators.topk import latest_n, top_k, top_share

SCOPE_LABELS = {"scope1": "Scope 1", "scope2": "Scope 2", "scope3": "Scope 3"}
SITE = "Data Center"


def _sites_only(combined: DataFrame) -> DataFrame:
    return combined.filter(F.col("facility_type") == SITE)


def k01_summary(emissions: DataFrame, operations: DataFrame) -> DataFrame:
    """Scope totals, latest month, the same month a year before, and data centre means."""
    monthly = emissions.groupBy("date").agg(*scope_sums())
    totals = monthly.agg(*[F.sum(c).alias(c) for c in ("scope1", "scope2", "scope3", "total")])
    recent = monthly.groupBy().agg(
        F.max("date").alias("recent_date"), F.max_by("total", "date").alias("recent_emissions")
    )
    prior = monthly.select(F.col("date").alias("_d"), F.col("total").alias("prior_emissions"))
    yoy = recent.join(prior, F.col("_d") == F.add_months("recent_date", -12), "left").drop("_d")
    yoy = yoy.withColumn("yoy_pct", F.round(pct_change("recent_emissions", "prior_emissions"), 1))
    fleet = operations.filter(F.col("pue").isNotNull()).agg(
        mean("pue").alias("avg_pue"), mean("cfe_pct").alias("avg_cfe"),
        mean("water_replenishment_pct").alias("avg_water_replen"),
        mean("waste_diversion_pct").alias("avg_waste_diversion"),
    )
    return with_constant_row(with_constant_row(totals, yoy), fleet)


def k01_summary_in_one_pass(combined: DataFrame) -> DataFrame:
    """The summary from facts that hold emissions and operations side by side: one aggregate by month, one over the months."""
    fleet = {"avg_pue": "pue", "avg_cfe": "cfe_pct", "avg_water_replen": "water_replenishment_pct", "avg_waste_diversion": "waste_diversion_pct"}
    site = F.col("pue").isNotNull()
    known = {name: F.when(site, F.col(c)) for name, c in fleet.items()}
    monthly = combined.groupBy("date").agg(
        *scope_sums(), *[F.sum(c).alias(f"s_{n}") for n, c in known.items()], *[F.count(c).alias(f"n_{n}") for n, c in known.items()]
    )
    # the calendar bounds the months of the map
    totals = F.map_from_entries(F.collect_list(F.struct("date", "total")))
    one = monthly.agg(
        *[F.sum(c).alias(c) for c in ("scope1", "scope2", "scope3", "total")], F.max("date").alias("recent_date"),
        F.max_by("total", "date").alias("recent_emissions"), totals.alias("_totals"),
        *[safe_div(F.sum(f"s_{n}"), F.sum(f"n_{n}")).alias(n) for n in fleet],
    ).withColumn("prior_emissions", F.try_element_at("_totals", F.add_months("recent_date", -12)))
    return one.select(
        "scope1", "scope2", "scope3", "total", "recent_date", "recent_emissions", "prior_emissions",
        F.round(pct_change("recent_emissions", "prior_emissions"), 1).alias("yoy_pct"), *fleet,
    )


def k02_scope_shares(emissions: DataFrame) -> DataFrame:
    """Tonnes and percent by scope."""
    wide = emissions.agg(*scope_sums())
    long = unpivot_report(wide, ["total"], SCOPE_LABELS, "scope", "emissions")
    return long.select("scope", "emissions", safe_div(F.col("emissions") * 100, "total").alias("percentage"))


def _yearly(emissions: DataFrame) -> DataFrame:
    return emissions.groupBy(year_of("date").alias("year")).agg(
        *scope_sums(), F.sum("renewable_pct").alias("pct_sum"), F.count("renewable_pct").alias("pct_n")
    )


def k03_latest_year(emissions: DataFrame) -> DataFrame:
    """Totals of the latest year with change on the year before (0 without one)."""
    yearly = _yearly(emissions)
    changed = Wn.period_change(
        yearly.withColumn("_jan", F.make_date("year", F.lit(1), F.lit(1))), "total", "_jan", 12
    )
    return latest_n(changed, "year", 1).select(
        "year", "scope1", "scope2", "scope3", "total",
        safe_div(F.col("scope3").cast("double") * 100, "total").alias("scope3_pct"),
        safe_div("pct_sum", "pct_n").alias("avg_renewable_pct"),
        F.coalesce("pct_change", F.lit(0.0)).alias("yoy_pct"),
    )


def k04_yearly(emissions: DataFrame) -> DataFrame:
    """Yearly table with percent change on the previous listed year."""
    yearly = A.scope_totals(emissions, [year_of("date").alias("year")])
    changed = Wn.period_change(yearly, "total", "year", 1, mode="rows")
    return changed.select("year", "scope1", "scope2", "scope3", "total", F.col("pct_change").alias("yoy_pct"))


def k05_monthly_trend(emissions: DataFrame) -> DataFrame:
    """Monthly totals with a 3-month average that starts at the third month."""
    monthly = A.scope_totals(emissions, [year_month("date").alias("month")])
    return Wn.moving_average(monthly, "total", "month", 2, strict=True, out="ma3")


def _by_site_in(emissions: DataFrame, year: int | None, *measures: Column) -> DataFrame:
    """Measures by facility in a year, by default the latest with readings, found among the facility-year sums."""
    if year is not None:
        return in_year(emissions, year).groupBy("facility_id").agg(*measures)
    sums = emissions.groupBy("facility_id", year_of("date").alias("_year")).agg(*measures)
    last = sums.agg(F.max("_year").alias("_last"))
    return with_constant_row(sums, last).filter(F.col("_year") == F.col("_last")).drop("_year", "_last")


def k06_top_facilities(
    emissions: DataFrame, facilities: DataFrame, year: int | None = None, measure: str = "total_emissions", k: int = 10
) -> DataFrame:
    """Largest facilities of a year, by default the latest, by total (or scope 1) emissions."""
    amount = total_emissions() if measure == "total_emissions" else F.col(measure)
    sums = _by_site_in(emissions, year, F.sum(amount).alias(measure))
    named = enrich(sums, facilities.select("facility_id", "facility_name", "region"), "facility_id")
    return top_k(named, measure, ["facility_id"], k)


def k07_regional(emissions: DataFrame, facilities: DataFrame, year: int | None = None) -> DataFrame:
    """Scope totals by region in a year, by default the latest; rows without a region are counted, not listed.

    ``row_count`` counts facility-months, ``facility_count`` facilities.
    """
    per_site = _by_site_in(emissions, year, *scope_sums(), F.count(F.lit(1)).alias("n"))
    placed = enrich(per_site, facilities.select("facility_id", "region"), "facility_id", "left")
    by_region = placed.groupBy("region").agg(
        *[F.sum(c).alias(c) for c in ("scope1", "scope2", "scope3", "total")],
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("facility_count"),
    )
    missing = by_region.agg(
        F.coalesce(F.sum(F.when(F.col("region").isNull(), F.col("row_count"))), F.lit(0)).alias("rows_without_region")
    )
    return with_constant_row(require(by_region, ["region"]), missing).orderBy("region")


def monthly_intensity(combined: DataFrame) -> DataFrame:
    """Monthly kg per MWh and tonnes per million units of water; months lacking either are dropped."""
    monthly = resample_monthly(combined, "date", {
        "total_emissions": ("sum", "total_emissions"),
        "electricity_mwh": ("sum", "electricity_mwh"),
        "water_consumption_gallons": ("sum", "water_consumption_gallons"),
    })
    out = monthly.withColumn("emissions_per_mwh", safe_div("total_emissions", "electricity_mwh") * 1000)
    out = out.withColumn(
        "emissions_per_mgal",
        safe_div("total_emissions", F.col("water_consumption_gallons").cast("double") / 1_000_000),
    )
    return require(out, [c for c in out.columns if c != "date"])


def k08_intensity(combined: DataFrame) -> DataFrame:
    """Monthly intensities with fitted trend lines and end-to-end change."""
    series = Wn.with_index(monthly_intensity(combined), "date")
    parts = []
    for c, tag in (("emissions_per_mwh", "mwh"), ("emissions_per_mgal", "mgal")):
        parts += [
            F.regr_slope(F.col(c), F.col("idx")).alias(f"slope_{tag}"),
            F.regr_intercept(F.col(c), F.col("idx")).alias(f"base_{tag}"),
            pct_change(F.max_by(c, "idx"), F.min_by(c, "idx")).alias(f"change_pct_{tag}"),
        ]
    lines = with_constant_row(series, series.agg(*parts))
    return lines.select(
        F.last_day("date").alias("date"), "total_emissions", "electricity_mwh", "water_consumption_gallons",
        "emissions_per_mwh", "emissions_per_mgal",
        (F.col("base_mwh") + F.col("slope_mwh") * F.col("idx")).alias("trend_per_mwh"),
        (F.col("base_mgal") + F.col("slope_mgal") * F.col("idx")).alias("trend_per_mgal"),
        "change_pct_mwh", "change_pct_mgal",
    )


def k09_absolute_vs_intensity(combined: DataFrame, n: int = 12) -> DataFrame:
    """First and last ``n`` months: emissions, electricity and mean intensity as report rows."""
    ends = A.head_tail(
        monthly_intensity(combined),
        {"total_emissions": "sum", "electricity_mwh": "sum", "emissions_per_mwh": "mean"}, "date", n,
    )
    rows = []
    for c, text in (
        ("total_emissions", "Total Emissions (tonnes)"),
        ("electricity_mwh", "Total Electricity (MWh)"),
        ("emissions_per_mwh", "Emissions Intensity (kg/MWh)"),
    ):
        first, last = F.col(f"first_{c}").cast("double"), F.col(f"last_{c}").cast("double")
        rows.append([F.lit(text), first, last, pct_change(last, first)])
    return stack_rows(ends, [], ["metric", "first_year", "latest_year", "change_pct"], rows)


def k10_insights(emissions: DataFrame) -> DataFrame:
    """Insight codes with their values for the latest year."""
    latest = k03_latest_year(emissions)
    per_site = emissions.groupBy("facility_id", year_of("date").alias("year")).agg(
        F.sum(total_emissions()).alias("total_emissions")
    )
    newest = with_constant_row(per_site, latest.select(F.col("year").alias("_y"))).filter("year = _y").drop("_y")
    concentration = top_share(newest, "total_emissions", ["facility_id"], 3)
    one = with_constant_row(latest, concentration)
    yoy, pct = F.col("yoy_pct"), F.col("avg_renewable_pct")
    rows = stack_rows(one, [], ["insight", "amount"], [
        [F.when(F.col("scope3_pct") > 70, "scope3_dominates"), F.col("scope3_pct")],
        [label([(yoy > 5, "emissions_increased"), (yoy < -5, "emissions_decreased")], "emissions_stable"), yoy],
        [label([(pct < 50, "low_renewable"), (pct > 75, "high_renewable")]), pct],
        [F.lit("top3_concentration"), F.col("top_share_pct")],
    ])
    return rows.filter(F.col("insight").isNotNull())


def k11_location_vs_market(emissions: DataFrame, year: int) -> DataFrame:
    """Monthly scope 2 on both bases with avoided tonnes and percent."""
    monthly = in_year(emissions, year).groupBy(year_month("date").alias("month")).agg(
        F.sum("scope2_location_tonnes").alias("location"), F.sum("scope2_market_tonnes").alias("market")
    )
    avoided = F.col("location") - F.col("market")
    return monthly.select(
        "month", "location", "market", avoided.alias("avoided"),
        safe_div(avoided.cast("double") * 100, "location").alias("avoided_pct"),
    )


def k12_renewable_by_month(emissions: DataFrame, year: int) -> DataFrame:
    return in_year(emissions, year).groupBy(year_month("date").alias("month")).agg(
        mean("renewable_pct").alias("renewable_pct")
    )


def k13_scope3_estimate(emissions: DataFrame, categories: DataFrame, year: int) -> DataFrame:
    """Scope 3 by category share with cumulative share; the top three are flagged and summed."""
    total = in_year(emissions, year).agg(F.sum("scope3_tonnes").alias("scope3"))
    split = allocate_by_share(total, "scope3", categories, F.col("typical_pct_of_scope3"), "estimated_tonnes")
    split = split.withColumn("estimated_tonnes", F.col("estimated_tonnes") / 100)
    pct = "typical_pct_of_scope3"
    # categories are a fixed table of at most fifteen rows
    order = W.orderBy(F.col(pct).desc(), "category_id")
    ranked = split.withColumn("position", F.row_number().over(order)).withColumn(
        "cumulative_pct", F.sum(pct).over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    top3 = ranked.agg(F.sum(F.when(F.col("position") <= 3, F.col(pct))).alias("top3_pct"))
    return with_constant_row(ranked, top3).select(
        "category_id", "category_name", "description", "estimated_tonnes", pct, "position", "cumulative_pct", "top3_pct"
    )


def k14_latest_operations(combined: DataFrame) -> DataFrame:
    """Operating figures of the latest month; PUE over data centres."""
    site = F.col("facility_type") == SITE
    monthly = combined.groupBy("date").agg(
        mean(F.when(site, F.col("pue"))).alias("fleet_pue"), mean("cfe_pct").alias("avg_cfe"),
        F.sum("water_consumption_gallons").alias("water_consumption"),
        mean("water_replenishment_pct").alias("avg_replenishment"),
        mean("waste_diversion_pct").alias("avg_diversion"),
    )
    return latest_n(monthly, "date", 1)


def _monthly_mean(df: DataFrame, column: str) -> DataFrame:
    return resample_monthly(df, "date", {column: ("mean", column)})


def _improvement(series: DataFrame, value: str) -> DataFrame:
    """Drop from first to last value, positive when it fell."""
    ends = A.first_last(require(series, [value]), value, "date")
    return ends.select(
        F.col("first_value"), F.col("last_value"), (-F.col("change")).alias("improvement"),
        (-F.col("pct_change")).alias("improvement_pct"),
    )


def k15_pue_trend(combined: DataFrame) -> DataFrame:
    series = _monthly_mean(_sites_only(combined), "pue")
    return with_constant_row(series, _improvement(series, "pue")).withColumn("date", F.last_day("date"))


def k15_pue_by_facility(combined: DataFrame) -> DataFrame:
    """Mean PUE per data centre with its band, best first."""
    per_site = _sites_only(combined).groupBy("facility_id", "facility_name").agg(mean("pue").alias("pue"))
    return per_site.withColumn("band", named_band("pue", "pue")).orderBy("pue", "facility_name")


def _best_worst(per_site: DataFrame, value: str, keep: Sequence[str]) -> DataFrame:
    """One row with the columns of the lowest (best_) and highest (worst_) row."""
    known = require(per_site, [value])
    row = F.struct(*keep)
    ends = known.agg(
        F.min_by(row, F.struct(F.col(value), F.col(keep[0]))).alias("b"),
        F.min_by(row, F.struct(-F.col(value), F.col(keep[0]))).alias("w"),
    )
    return ends.select(
        *[F.col(f"b.{c}").alias(f"best_{c}") for c in keep], *[F.col(f"w.{c}").alias(f"worst_{c}") for c in keep]
    )


def k15_best_worst(combined: DataFrame) -> DataFrame:
    """Best and worst data centre by PUE and the energy saving of closing the gap."""
    ends = _best_worst(k15_pue_by_facility(combined), "pue", ["facility_name", "pue"])
    return ends.withColumn("saving_pct", safe_div(F.col("worst_pue") - F.col("best_pue"), "worst_pue") * 100)


def k16_cfe_trend(combined: DataFrame) -> DataFrame:
    series = _monthly_mean(combined, "cfe_pct").withColumn("cfe_pct", F.col("cfe_pct") * 100)
    newest = require(series, ["cfe_pct"]).agg(F.max_by("cfe_pct", "date").alias("current_cfe"))
    return with_constant_row(series, newest.withColumn("band", named_band("current_cfe", "cfe_current"))).withColumn(
        "date", F.last_day("date")
    )


def k16_cfe_by_region(combined: DataFrame) -> DataFrame:
    ranked = combined.groupBy("region").agg((mean("cfe_pct") * 100).alias("cfe_pct"))
    return ranked.withColumn("band", named_band("cfe_pct", "cfe_region")).orderBy(F.col("cfe_pct").desc(), "region")


def k17_water_trend(combined: DataFrame) -> DataFrame:
    series = resample_monthly(combined, "date", {
        "water_consumption_gallons": ("sum", "water_consumption_gallons"),
        "water_replenishment_pct": ("mean", "water_replenishment_pct"),
    })
    band = named_band(F.col("water_replenishment_pct") * 100, "replenishment")
    return series.withColumn("band", band).withColumn("date", F.last_day("date"))


def k17_water_intensity(combined: DataFrame) -> DataFrame:
    return combined.groupBy("facility_type").agg(
        ratio_of_sums("water_consumption_gallons", "electricity_mwh").alias("water_per_mwh")
    ).orderBy(F.col("water_per_mwh").desc(), "facility_type")


def k18_waste(combined: DataFrame) -> DataFrame:
    series = resample_monthly(combined, "date", {
        "waste_generated_tons": ("sum", "waste_generated_tons"),
        "waste_diverted_tons": ("sum", "waste_diverted_tons"),
        "waste_diversion_pct": ("mean", "waste_diversion_pct"),
    })
    landfill = F.col("waste_generated_tons") - F.col("waste_diverted_tons")
    band = named_band(F.col("waste_diversion_pct") * 100, "diversion")
    return series.withColumns({"waste_landfill_tons": landfill, "band": band, "date": F.last_day("date")})


SCORES = ["pue_score", "cfe_score", "replenishment_score", "water_score", "diversion_score"]


def k19_scorecard(combined: DataFrame) -> DataFrame:
    """Scores 0-100 of the data centres in the latest month (of any facility), their mean and band."""
    site = F.col("facility_type") == SITE

    def over_sites(c: str) -> Column:
        return mean(F.when(site, F.col(c)))

    monthly = combined.groupBy("date").agg(
        over_sites("pue").alias("pue"), over_sites("cfe_pct").alias("cfe"),
        over_sites("water_replenishment_pct").alias("replenishment"),
        over_sites("waste_diversion_pct").alias("diversion"),
        F.avg(F.when(site, safe_div("water_consumption_gallons", "electricity_mwh"))).alias("water_per_mwh"),
        F.count_if(site).alias("n_sites"),
    )
    scored = latest_n(monthly, "date", 1).filter(F.col("n_sites") > 0).select(
        "date",
        ((F.lit(1.5) - F.col("pue")) / 0.5 * 100).alias("pue_score"),
        (F.col("cfe") * 100).alias("cfe_score"),
        (F.col("replenishment") * 100).alias("replenishment_score"),
        clamp(100 - F.col("water_per_mwh") / 2, lo=0.0).alias("water_score"),
        (F.col("diversion") * 100).alias("diversion_score"),
    )
    scored = scored.withColumn("overall_score", A.composite(SCORES))
    return scored.withColumn("band", named_band("overall_score", "overall_score"))


def k20_strengths(combined: DataFrame) -> DataFrame:
    """Strength and opportunity codes drawn from the scorecard."""
    one = k19_scorecard(combined)
    rules = [
        ("strength", "pue", F.col("pue_score") > 80, "pue_score"),
        ("strength", "carbon_free_energy", F.col("cfe_score") > 70, "cfe_score"),
        ("strength", "water_replenishment", F.col("replenishment_score") > 60, "replenishment_score"),
        ("strength", "waste_diversion", F.col("diversion_score") > 80, "diversion_score"),
        ("opportunity", "pue", F.col("pue_score") < 70, "pue_score"),
        ("opportunity", "carbon_free_energy", F.col("cfe_score") < 60, "cfe_score"),
        ("opportunity", "water_replenishment", F.col("replenishment_score") < 50, "replenishment_score"),
        ("opportunity", "waste_diversion", F.col("diversion_score") < 75, "diversion_score"),
    ]
    rows = [[F.lit(kind), F.lit(area), F.col(c), hit] for kind, area, hit, c in rules]
    return stack_rows(one, [], ["kind", "area", "score", "_hit"], rows).filter("_hit").drop("_hit")


def yearly_operations(combined: DataFrame, last_year: int) -> DataFrame:
    """Yearly operating means and sums; water per MWh is the mean of row ratios."""
    return year_range(combined, None, last_year).groupBy(year_of("date").alias("year")).agg(
        mean("pue").alias("pue"), mean("cfe_pct").alias("cfe_pct"),
        mean_of_ratios("water_consumption_gallons", "electricity_mwh").alias("water_per_mwh"),
        mean("waste_diversion_pct").alias("waste_diversion_pct"),
        F.sum("electricity_mwh").alias("electricity_mwh"),
        F.sum("water_consumption_gallons").alias("water_consumption_gallons"),
    )


def _ends(yearly: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last year's values in one row; none for fewer than two years."""
    picks = [F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n_years")]
    for c in columns:
        picks += [F.min_by(c, "year").alias(f"first_{c}"), F.max_by(c, "year").alias(f"last_{c}")]
    return yearly.agg(*picks).filter(F.col("n_years") >= 2)


def k21_improvements(combined: DataFrame, last_year: int) -> DataFrame:
    """First against last full year."""
    cols = ["pue", "cfe_pct", "water_per_mwh", "waste_diversion_pct", "electricity_mwh"]
    e = _ends(yearly_operations(combined, last_year), cols)
    pue = F.col("first_pue") - F.col("last_pue")
    water = F.col("first_water_per_mwh") - F.col("last_water_per_mwh")
    return e.select(
        "first_year", "last_year", (F.col("last_year") - F.col("first_year")).alias("years_span"),
        "first_pue", "last_pue", pue.alias("pue_improvement"), safe_div(pue * 100, "first_pue").alias("pue_pct"),
        (F.col("last_cfe_pct") - F.col("first_cfe_pct")).alias("cfe_improvement"),
        water.alias("water_improvement"), safe_div(water * 100, "first_water_per_mwh").alias("water_pct"),
        (F.col("last_waste_diversion_pct") - F.col("first_waste_diversion_pct")).alias("diversion_improvement"),
        F.col("last_electricity_mwh").cast("double").alias("last_electricity_mwh"),
    )


def k22_benchmark(combined: DataFrame, energy_price: float = L.ENERGY_PRICE) -> DataFrame:
    """Best and worst data centre by PUE and the yearly value of closing the gap (thousand $)."""
    per_site = _sites_only(combined).groupBy("facility_id", "facility_name").agg(
        mean("pue").alias("pue"), mean("cfe_pct").alias("cfe_pct"),
        mean_of_ratios("water_consumption_gallons", "electricity_mwh").alias("water_per_mwh"),
        mean("electricity_mwh").alias("electricity_mwh"),
    )
    ends = _best_worst(per_site, "pue", ["facility_name", "pue", "cfe_pct", "water_per_mwh", "electricity_mwh"])
    gap = F.col("worst_pue") - F.col("best_pue")
    value = F.col("worst_electricity_mwh") * safe_div(gap, "worst_pue") * energy_price / 1000 * 12
    return ends.withColumn("gap", gap).withColumn("potential_kusd_per_year", value)


def k23_pue_projection(combined: DataFrame, last_year: int, horizon: int, energy_price: float = L.ENERGY_PRICE) -> DataFrame:
    """PUE at the horizon by least squares on year, and what the improvement is worth.

    Cumulative value takes six ramping years (half of them on average); the
    investment estimate is 2.5 years of savings. Needs three years.
    """
    yearly = yearly_operations(combined, last_year)
    fit = A.linear_trend(yearly, "pue", "year").filter(F.col("n") >= 3)
    now = yearly.agg(F.max_by("pue", "year").alias("current_pue"), F.max_by("electricity_mwh", "year").alias("mwh"))
    one = with_constant_row(fit, now).withColumn("projected_pue", F.col("slope") * horizon + F.col("intercept"))
    gain = F.col("current_pue") - F.col("projected_pue")
    saved = F.when(gain > 0, F.col("mwh").cast("double") * safe_div(gain, "current_pue"))
    value = saved * energy_price / 1000
    return one.select(
        "current_pue", "projected_pue", gain.alias("improvement"), (-F.col("slope")).alias("annual_rate"),
        named_band("projected_pue", "pue_projection").alias("band"),
        saved.alias("energy_saved_mwh"), value.alias("cost_savings_kusd"),
        (value * 6 / 2).alias("cumulative_kusd"), (value * 2.5).alias("investment_kusd"),
    )


def k25_coverage(combined: DataFrame) -> DataFrame:
    """Records, facilities and months. Two plain counts over facility and month groups."""
    cells = combined.groupBy("facility_id", "date").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(
        F.sum("n").alias("records"), F.count_distinct("facility_id").alias("facilities"),
        F.count_distinct("date").alias("months"),
    )


def k26_stacked_scopes(emissions: DataFrame, year: int) -> DataFrame:
    return in_year(emissions, year).groupBy(year_month("date").alias("month")).agg(*scope_sums()[:3])
