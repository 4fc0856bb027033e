"""Projections, predicates and scalar functions as registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from scopeledger.catalog.registry import query
from scopeledger.functions import scalars as S
from scopeledger.operators import filters as Fl
from scopeledger.operators.joins import lookup
from scopeledger.operators.reshape import rename_report
from scopeledger.sources.binding import YEAR, Bound


@query("p01_total_emissions", "select facility_id, date, cast(total_emissions as double) as total_emissions from emis")
def p01(b: Bound):
    return b.emissions().select("facility_id", "date", S.total_emissions().alias("total_emissions"))


@query("p02_date_parts", """
select facility_id, date, cast(year(date) as bigint) as year, cast(month(date) as bigint) as month, strftime(date, '%Y-%m') as year_month from emissions""")
def p02(b: Bound):
    return b.emissions().select(
        "facility_id", "date", S.year_of("date").alias("year"), S.month_of("date").alias("month"),
        S.year_month("date").alias("year_month"),
    )


@query("p03_parse_dates", """
with t as (select o_orderkey, case when o_orderkey % 11 = 0 then 'n/a' else strftime(o_orderdate, '%Y-%m-%d') end as text from orders)
select o_orderkey, try_cast(text as date) as parsed from t""")
def p03(b: Bound):
    text = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return b.read("orders").select("o_orderkey", S.parse_date(text, lenient=True).alias("parsed"))


@query("p04_shift_year", "select distinct date, cast(date - interval 1 year as date) as a_year_before from emissions")
def p04(b: Bound):
    months = b.emissions().select("date").distinct()
    return months.select("date", S.shift_year("date", -1).alias("a_year_before"))


@query("p05_rows_up_to_date", """
select cast(year(date) as bigint) as year, count(*) as rows from emissions where date <= date '1999-06-30' group by 1""")
def p05(b: Bound):
    kept = b.emissions().filter(F.col("date") <= S.as_of(date(1999, 6, 30)))
    return kept.groupBy(S.year_of("date").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


@query("p06_month_end", "select o_orderkey, last_day(cast(o_orderdate as date)) as month_end from orders")
def p06(b: Bound):
    return b.read("orders").select("o_orderkey", S.month_end(F.col("o_orderdate").cast("date")).alias("month_end"))


@query("p07_rounding", """
select facility_id, date, cast(round(scope2_market_tonnes, 0) as double) as whole, cast(round(scope2_market_tonnes, 2) as double) as cents from emissions""")
def p07(b: Bound):
    c = "scope2_market_tonnes"
    return b.emissions().select(
        "facility_id", "date", S.round_half_up(c).alias("whole"), S.round_half_up(c, 2).alias("cents")
    )


@query("p08_safe_division", """
select facility_id, date, cast(total_emissions as double) / nullif(cast(scope1_tonnes - 100 as double), 0) as ratio from emis""")
def p08(b: Bound):
    return b.emissions().select(
        "facility_id", "date", S.safe_div(S.total_emissions(), F.col("scope1_tonnes") - 100).alias("ratio")
    )


@query("p09_finite_values", """
with t as (select event_id, case when event_id % 7 = 0 then 'nan'::double when event_id % 5 = 0 then 'inf'::double when event_id % 3 = 0 then null else value end as v from events)
select event_id, v as clean from t where not isnan(v) and not isinf(v)""")
def p09(b: Bound):
    k = F.col("event_id")
    raw = F.when(k % 7 == 0, float("nan")).when(k % 5 == 0, float("inf")).when(k % 3 == 0, None).otherwise(F.col("value"))
    return Fl.require(b.read("events").select("event_id", S.finite(raw).alias("clean")), ["clean"])


@query("p10_searched_labels", """
select facility_id, date, case when renewable_pct >= 75 then 'high' when renewable_pct >= 50 then 'middle' else 'low' end as tier from emissions""")
def p10(b: Bound):
    pct = F.col("renewable_pct")
    return b.emissions().select("facility_id", "date", S.label([(pct >= 75, "high"), (pct >= 50, "middle")], "low").alias("tier"))


@query("p11_coalesce_label", """
select c_custkey, coalesce(case when c_custkey % 4 <> 0 then c_mktsegment end, 'Unassigned') as segment from customer""")
def p11(b: Bound):
    segment = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return b.read("customer").select("c_custkey", S.coalesce_label(segment, "Unassigned").alias("segment"))


@query("p12_in_list", "select facility_id, region from facilities where region in ('EU', 'APAC')")
def p12(b: Bound):
    return Fl.keep_values(b.facilities(), "region", ["EU", "APAC"]).select("facility_id", "region")


@query("p12_long_list_semi_join", "select count(*) as rows, cast(sum(scope1_tonnes) as double) as scope1 from emissions where facility_id % 3 = 1 and facility_id < 900")
def p12_long(b: Bound):
    kept = Fl.keep_values(b.emissions(), "facility_id", list(range(1, 900, 3)))
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.sum("scope1_tonnes").alias("scope1"))


@query("p13_inclusive_date_range", """
select facility_id, date, cast(scope3_tonnes as double) as scope3_tonnes from emissions where date >= '1997-03-01' and date <= '1997-09-01'""")
def p13(b: Bound):
    start, end = date(1997, 3, 1), date(1997, 9, 1)
    return Fl.apply_filters(b.emissions(start, end), start=start, end=end).select("facility_id", "date", "scope3_tonnes")


@query("p14_year_as_range", "select facility_id, date, cast(scope3_tonnes as double) as scope3_tonnes from emissions where year(date) = 1998")
def p14(b: Bound):
    one_year = Fl.in_year(b.emissions(date(YEAR, 1, 1), date(YEAR, 12, 1)), YEAR)
    return one_year.select("facility_id", "date", "scope3_tonnes")


@query("p15_required_columns", "select facility_id, date, cast(pue as double) as pue from combined where pue is not null and energy_cost_usd is not null")
def p15(b: Bound):
    return Fl.require(b.combined(), ["pue", "energy_cost_usd"]).select("facility_id", "date", "pue")


@query("p16_distinct_values", "select distinct region from facilities")
def p16(b: Bound):
    return Fl.domain(b.facilities(), "region")


@query("p17_clamp", """
select event_id, case when value is not null then least(greatest(value, 5::double), 20::double) end as clamped from events""")
def p17(b: Bound):
    return b.read("events").select("event_id", S.clamp("value", 5.0, 20.0).alias("clamped"))


@query("p18_abs_power_root", """
select event_id, abs(value - 10) as distance, value * value as squared, sqrt(abs(value)) as root from events""")
def p18(b: Bound):
    v = F.col("value")
    return b.read("events").select(
        "event_id", F.abs(v - 10).alias("distance"), (v * v).alias("squared"), F.sqrt(F.abs(v)).alias("root")
    )


@query("p19_text_year_to_int", """
select facility_id, date, cast(cast(strftime(date, '%Y') as integer) - 1995 as bigint) as years_since_baseline from emissions""")
def p19(b: Bound):
    text = F.date_format("date", "yyyy")
    return b.emissions().select("facility_id", "date", (S.year_int(text) - 1995).alias("years_since_baseline"))


@query("p20_lookup_with_default", """
select facility_id, f.region, cast(coalesce(energy_price, 70) as double) as energy_price from facilities f left join prices p on f.region = p.region""")
def p20(b: Bound):
    from scopeledger.model.lookups import REGION_DEFAULTS

    priced = lookup(b.facilities(), b.regional_prices(), "region", "energy_price", REGION_DEFAULTS["energy_price"])
    return priced.select("facility_id", "region", "energy_price")


@query("p21_threshold_bands", """
select facility_id, date,
       case when pue is null then null when pue < 1.10 then 'good' when pue < 1.15 then 'fair' else 'poor' end as pue_band,
       case when cfe_pct * 100 > 70 then 'good' when cfe_pct * 100 > 40 then 'fair' else 'poor' end as cfe_band,
       case when waste_diversion_pct * 100 >= 85 then 'excellent' when waste_diversion_pct * 100 >= 75 then 'good' else 'opportunity' end as diversion_band
from operations""")
def p21(b: Bound):
    return b.operations().select(
        "facility_id", "date", S.named_band("pue", "pue").alias("pue_band"),
        S.named_band(F.col("cfe_pct") * 100, "cfe_region").alias("cfe_band"),
        S.named_band(F.col("waste_diversion_pct") * 100, "diversion").alias("diversion_band"),
    )


@query("p22_display_text", """
with y as (select year(date) as year, sum(total_emissions) as t from emis group by 1)
select cast(year as bigint) as year, format('{:,}', cast(round(t, 0) as bigint)) as grouped from y""")
def p22(b: Bound):
    yearly = b.emissions().groupBy(S.year_of("date").alias("year")).agg(F.round(F.sum(S.total_emissions()), 0).alias("t"))
    return yearly.select("year", S.display_number("t", ",0").alias("grouped"))


@query("p24_report_names", """
select cast(year(date) as bigint) as "Year", cast(sum(scope1_tonnes) as double) as "Scope 1", cast(sum(scope3_tonnes) as double) as "Scope 3" from emissions group by 1""")
def p24(b: Bound):
    yearly = b.emissions().groupBy(S.year_of("date").alias("year")).agg(
        F.sum("scope1_tonnes").alias("scope1"), F.sum("scope3_tonnes").alias("scope3")
    )
    return rename_report(yearly, {"year": "Year", "scope1": "Scope 1", "scope3": "Scope 3"})
