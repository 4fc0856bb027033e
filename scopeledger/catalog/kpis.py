"""Dashboard figures as registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from scopeledger.catalog.registry import query
from scopeledger.operators.filters import apply_filters
from scopeledger.plans import kpis as K
from scopeledger.sources.binding import LAST_FULL_YEAR, YEAR, Bound

FIRST, LAST = date(YEAR, 1, 1), date(YEAR, 12, 1)
HORIZON = 2007


def mean_sql(c: str) -> str:
    return f"(cast(sum({c}) as double) / nullif(count({c}), 0))"


def change_sql(new: str, old: str) -> str:
    return f"((cast({new} as double) - cast({old} as double)) / nullif(cast({old} as double), 0) * 100)"


@query("k01_summary_kpis", f"""
with t as (select cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2,
                  cast(sum(scope3_tonnes) as double) as scope3, cast(sum(total_emissions) as double) as total from emis),
m as (select date, sum(total_emissions) as v from emis group by 1),
r as (select date as recent_date, v from m order by date desc limit 1),
y as (select recent_date, cast(r.v as double) as recent_emissions, cast(p.v as double) as prior_emissions,
             round({change_sql('r.v', 'p.v')}, 1) as yoy_pct
      from r left join m p on p.date = r.recent_date - interval 1 year),
o as (select {mean_sql('pue')} as avg_pue, {mean_sql('cfe_pct')} as avg_cfe, {mean_sql('water_replenishment_pct')} as avg_water_replen,
             {mean_sql('waste_diversion_pct')} as avg_waste_diversion from operations where pue is not null)
select * from t, y, o""")
def k01(b: Bound):
    return K.k01_summary_in_one_pass(b.combined())


@query("k02_scope_shares", """
with t as (select cast(sum(scope1_tonnes) as double) as s1, cast(sum(scope2_market_tonnes) as double) as s2,
                  cast(sum(scope3_tonnes) as double) as s3, cast(sum(total_emissions) as double) as t from emis),
l as (select 'Scope 1' as scope, s1 as emissions, t from t union all select 'Scope 2', s2, t from t union all select 'Scope 3', s3, t from t)
select scope, emissions, emissions * 100 / t as percentage from l""")
def k02(b: Bound):
    return K.k02_scope_shares(b.meters(unit="year"))


_YEARLY = """
with y as (select year(date) as year, sum(scope1_tonnes) as s1, sum(scope2_market_tonnes) as s2, sum(scope3_tonnes) as s3,
                  sum(total_emissions) as t, sum(renewable_pct) as ps, count(renewable_pct) as pn from emis group by 1)"""


@query("k03_latest_year_kpis", _YEARLY + f"""
select cast(a.year as bigint) as year, cast(a.s1 as double) as scope1, cast(a.s2 as double) as scope2, cast(a.s3 as double) as scope3,
       cast(a.t as double) as total, cast(a.s3 as double) * 100 / cast(a.t as double) as scope3_pct,
       cast(a.ps as double) / a.pn as avg_renewable_pct, coalesce({change_sql('a.t', 'p.t')}, 0) as yoy_pct
from y a left join y p on p.year = a.year - 1 where a.year = (select max(year) from y)""")
def k03(b: Bound):
    return K.k03_latest_year(b.emissions())


@query("k04_yearly_change", _YEARLY + f""",
l as (select *, lag(t) over (order by year) as p from y)
select cast(year as bigint) as year, cast(s1 as double) as scope1, cast(s2 as double) as scope2, cast(s3 as double) as scope3,
       cast(t as double) as total, {change_sql('t', 'p')} as yoy_pct from l""")
def k04(b: Bound):
    return K.k04_yearly(b.meters(unit="year"))


@query("k05_monthly_trend_ma3", """
with m as (select strftime(date, '%Y-%m') as month, sum(scope1_tonnes) as s1, sum(scope2_market_tonnes) as s2,
                  sum(scope3_tonnes) as s3, sum(total_emissions) as t from emis group by 1)
select month, cast(s1 as double) as scope1, cast(s2 as double) as scope2, cast(s3 as double) as scope3, cast(t as double) as total,
       case when count(*) over w = 3 then cast(sum(t) over w as double) / 3 end as ma3
from m window w as (order by month rows between 2 preceding and current row)""")
def k05(b: Bound):
    return K.k05_monthly_trend(b.meters())


_TOP = """
select f.facility_id, cast(sum({m}) as double) as {m}, facility_name, region
from emis e join facilities f on e.facility_id = f.facility_id where year(date) = (select max(year(date)) from emis)
group by f.facility_id, facility_name, region order by sum({m}) desc, f.facility_id limit 10"""


@query("k06_top_facilities", _TOP.format(m="total_emissions"))
def k06(b: Bound):
    return K.k06_top_facilities(b.meters(facility=True, unit="year"), b.facilities())


@query("k06_top_facilities_scope1", _TOP.format(m="scope1_tonnes"))
def k06_scope1(b: Bound):
    return K.k06_top_facilities(b.meters(facility=True, unit="year"), b.facilities(), measure="scope1_tonnes")


@query("k07_regional_breakdown", """
with p as (select e.*, case when f.facility_id % 10 <> 0 then f.region end as region from emis e join facilities f on e.facility_id = f.facility_id
           where year(date) = (select max(year(date)) from emis))
select region, cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2,
       cast(sum(scope3_tonnes) as double) as scope3, cast(sum(total_emissions) as double) as total,
       count(*) as row_count, count(distinct facility_id) as facility_count, (select count(*) from p where region is null) as rows_without_region
from p where region is not null group by region""")
def k07(b: Bound):
    """Some facilities lack a region here."""
    region = F.when(F.col("facility_id") % 10 != 0, F.col("region"))
    return K.k07_regional(b.emissions(), b.facilities().withColumn("region", region))


_INTENSITY = """
with m as (select date, sum(total_emissions) as t, sum(electricity_mwh) as e, sum(water_consumption_gallons) as w from combined group by 1),
i as (select date, cast(t as double) as t, cast(e as double) as e, cast(w as double) as w,
             cast(t as double) / cast(e as double) * 1000 as pm, cast(t as double) / (cast(w as double) / 1000000) as pw,
             row_number() over (order by date) - 1 as idx from m)"""


@query("k08_intensity_trend", _INTENSITY + """,
f as (select regr_slope(pm, idx) as sm, regr_intercept(pm, idx) as im, regr_slope(pw, idx) as sw, regr_intercept(pw, idx) as iw,
             (arg_max(pm, idx) - arg_min(pm, idx)) / arg_min(pm, idx) * 100 as cm,
             (arg_max(pw, idx) - arg_min(pw, idx)) / arg_min(pw, idx) * 100 as cw from i)
select last_day(date) as date, t as total_emissions, e as electricity_mwh, w as water_consumption_gallons,
       pm as emissions_per_mwh, pw as emissions_per_mgal, round(im + sm * idx, 3) as trend_per_mwh, round(iw + sw * idx, 3) as trend_per_mgal,
       cm as change_pct_mwh, cw as change_pct_mgal from i, f""", digits={"trend_per_mwh": 3, "trend_per_mgal": 3})
def k08(b: Bound):
    return K.k08_intensity(b.combined())


@query("k09_absolute_vs_intensity", _INTENSITY + """,
r as (select *, row_number() over (order by date desc) - 1 as back from i),
a as (select 'Total Emissions (tonnes)' as metric, sum(case when idx < 12 then t end) as f, sum(case when back < 12 then t end) as l from r
      union all select 'Total Electricity (MWh)', sum(case when idx < 12 then e end), sum(case when back < 12 then e end) from r
      union all select 'Emissions Intensity (kg/MWh)', avg(case when idx < 12 then pm end), avg(case when back < 12 then pm end) from r)
select metric, round(f, 3) as first_year, round(l, 3) as latest_year, round((l - f) / f * 100, 6) as change_pct from a""",
       digits={"first_year": 3, "latest_year": 3, "change_pct": 6})
def k09(b: Bound):
    return K.k09_absolute_vs_intensity(b.combined())


@query("k10_insights", _YEARLY + f""",
l as (select a.t, cast(a.s3 as double) * 100 / cast(a.t as double) as s3p, cast(a.ps as double) / a.pn as ren,
             coalesce({change_sql('a.t', 'p.t')}, 0) as yoy from y a left join y p on p.year = a.year - 1
      where a.year = (select max(year) from y)),
s as (select facility_id, sum(total_emissions) as t from emis where year(date) = (select max(year) from y) group by 1),
c as (select cast((select sum(t) from (select t from s order by t desc, facility_id limit 3)) as double) * 100 / cast((select sum(t) from s) as double) as top3),
o as (select 'scope3_dominates' as insight, s3p as amount from l where s3p > 70
      union all select case when yoy > 5 then 'emissions_increased' when yoy < -5 then 'emissions_decreased' else 'emissions_stable' end, yoy from l
      union all select case when ren < 50 then 'low_renewable' else 'high_renewable' end, ren from l where ren < 50 or ren > 75
      union all select 'top3_concentration', top3 from c)
select * from o""")
def k10(b: Bound):
    return K.k10_insights(b.emissions())


@query("k11_location_vs_market", """
select strftime(date, '%Y-%m') as month, cast(sum(scope2_location_tonnes) as double) as location, cast(sum(scope2_market_tonnes) as double) as market,
       cast(sum(scope2_location_tonnes) - sum(scope2_market_tonnes) as double) as avoided,
       cast(sum(scope2_location_tonnes) - sum(scope2_market_tonnes) as double) * 100 / cast(sum(scope2_location_tonnes) as double) as avoided_pct
from emissions where year(date) = 1998 group by 1""")
def k11(b: Bound):
    return K.k11_location_vs_market(b.meters(FIRST, LAST), YEAR)


@query("k12_renewable_by_month", f"""
select strftime(date, '%Y-%m') as month, {mean_sql('renewable_pct')} as renewable_pct from emissions where year(date) = 1998 group by 1""")
def k12(b: Bound):
    return K.k12_renewable_by_month(b.emissions(FIRST, LAST), YEAR)


@query("k13_scope3_estimate", """
with t as (select cast(sum(scope3_tonnes) as double) as s3 from emissions where year(date) = 1998),
r as (select *, row_number() over (order by typical_pct_of_scope3 desc, category_id) as position,
             sum(typical_pct_of_scope3) over (order by typical_pct_of_scope3 desc, category_id rows unbounded preceding) as cumulative_pct from categories)
select cast(category_id as bigint) as category_id, category_name, description, s3 * typical_pct_of_scope3 / 100 as estimated_tonnes,
       typical_pct_of_scope3, position, cumulative_pct, (select sum(typical_pct_of_scope3) from r where position <= 3) as top3_pct from r, t""")
def k13(b: Bound):
    return K.k13_scope3_estimate(b.meters(FIRST, LAST, unit="year"), b.categories(), YEAR)


@query("k14_latest_operations", f"""
select date, {mean_sql("case when facility_type = 'Data Center' then pue end")} as fleet_pue, {mean_sql('cfe_pct')} as avg_cfe,
       cast(sum(water_consumption_gallons) as double) as water_consumption, {mean_sql('water_replenishment_pct')} as avg_replenishment,
       {mean_sql('waste_diversion_pct')} as avg_diversion
from combined where date = (select max(date) from combined) group by date""")
def k14(b: Bound):
    return K.k14_latest_operations(b.combined())


@query("k15_pue_trend", f"""
with m as (select date, {mean_sql('pue')} as pue from combined where facility_type = 'Data Center' group by 1),
e as (select arg_min(pue, date) as first_value, arg_max(pue, date) as last_value from m where pue is not null)
select last_day(date) as date, pue, first_value, last_value, -(last_value - first_value) as improvement,
       -((last_value - first_value) / first_value * 100) as improvement_pct from m, e""")
def k15(b: Bound):
    return K.k15_pue_trend(b.combined())


_PUE = f"""
with p as (select facility_id, facility_name, {mean_sql('pue')} as pue from combined where facility_type = 'Data Center' group by 1, 2)"""


@query("k15_pue_by_facility", _PUE + """
select *, case when pue < 1.10::double then 'good' when pue < 1.15::double then 'fair' else 'poor' end as band from p""")
def k15_facility(b: Bound):
    return K.k15_pue_by_facility(b.combined())


@query("k15_best_worst", _PUE + """,
b as (select * from p order by pue, facility_name limit 1), w as (select * from p order by pue desc, facility_name limit 1)
select b.facility_name as best_facility_name, b.pue as best_pue, w.facility_name as worst_facility_name, w.pue as worst_pue,
       (w.pue - b.pue) / w.pue * 100 as saving_pct from b, w""")
def k15_ends(b: Bound):
    return K.k15_best_worst(b.combined())


@query("k16_cfe_trend", f"""
with m as (select date, {mean_sql('cfe_pct')} * 100 as cfe_pct from combined group by 1), c as (select arg_max(cfe_pct, date) as v from m)
select last_day(date) as date, cfe_pct, v as current_cfe,
       case when v >= 70 then 'excellent' when v >= 50 then 'good' else 'opportunity' end as band from m, c""")
def k16(b: Bound):
    return K.k16_cfe_trend(b.combined())


@query("k16_cfe_by_region", f"""
with r as (select region, {mean_sql('cfe_pct')} * 100 as cfe_pct from combined group by 1)
select *, case when cfe_pct > 70 then 'good' when cfe_pct > 40 then 'fair' else 'poor' end as band from r""")
def k16_region(b: Bound):
    return K.k16_cfe_by_region(b.combined())


@query("k17_water_trend", f"""
with m as (select date, cast(sum(water_consumption_gallons) as double) as water_consumption_gallons,
                  {mean_sql('water_replenishment_pct')} as water_replenishment_pct from combined group by 1)
select last_day(date) as date, water_consumption_gallons, water_replenishment_pct,
       case when water_replenishment_pct * 100 >= 80 then 'excellent' when water_replenishment_pct * 100 >= 50 then 'good' else 'opportunity' end as band from m""")
def k17(b: Bound):
    return K.k17_water_trend(b.combined())


@query("k17_water_intensity_by_type", """
select facility_type, cast(sum(water_consumption_gallons) as double) / nullif(cast(sum(electricity_mwh) as double), 0) as water_per_mwh
from combined group by 1""")
def k17_type(b: Bound):
    return K.k17_water_intensity(b.combined())


@query("k18_waste_trend", f"""
with m as (select date, cast(sum(waste_generated_tons) as double) as waste_generated_tons, cast(sum(waste_diverted_tons) as double) as waste_diverted_tons,
                  {mean_sql('waste_diversion_pct')} as waste_diversion_pct,
                  cast(sum(waste_generated_tons) - sum(waste_diverted_tons) as double) as waste_landfill_tons from combined group by 1)
select last_day(date) as date, waste_generated_tons, waste_diverted_tons, waste_diversion_pct, waste_landfill_tons,
       case when waste_diversion_pct * 100 >= 85 then 'excellent' when waste_diversion_pct * 100 >= 75 then 'good' else 'opportunity' end as band from m""")
def k18(b: Bound):
    return K.k18_waste(b.combined())


_SCORES = f"""
with d as (select date, {mean_sql('pue')} as pue, {mean_sql('cfe_pct')} as cfe, {mean_sql('water_replenishment_pct')} as rep,
                  {mean_sql('waste_diversion_pct')} as div, avg(cast(water_consumption_gallons as double) / nullif(cast(electricity_mwh as double), 0)) as w
           from combined where facility_type = 'Data Center' and date = (select max(date) from combined) group by 1),
s as (select date, (1.5::double - pue) / 0.5::double * 100 as pue_score, cfe * 100 as cfe_score, rep * 100 as replenishment_score,
             greatest(0, 100 - w / 2) as water_score, div * 100 as diversion_score from d)"""


@query("k19_scorecard", _SCORES + """,
o as (select *, (pue_score + cfe_score + replenishment_score + water_score + diversion_score) / 5 as overall_score from s)
select date, pue_score, cfe_score, replenishment_score, round(water_score, 6) as water_score, diversion_score, round(overall_score, 6) as overall_score,
       case when overall_score >= 80 then 'leader' when overall_score >= 65 then 'strong' else 'improve' end as band from o""",
       digits={"water_score": 6, "overall_score": 6})
def k19(b: Bound):
    return K.k19_scorecard(b.combined())


@query("k20_strengths_opportunities", _SCORES + """
select * from (
select 'strength' as kind, 'pue' as area, pue_score as score from s where pue_score > 80
union all select 'strength', 'carbon_free_energy', cfe_score from s where cfe_score > 70
union all select 'strength', 'water_replenishment', replenishment_score from s where replenishment_score > 60
union all select 'strength', 'waste_diversion', diversion_score from s where diversion_score > 80
union all select 'opportunity', 'pue', pue_score from s where pue_score < 70
union all select 'opportunity', 'carbon_free_energy', cfe_score from s where cfe_score < 60
union all select 'opportunity', 'water_replenishment', replenishment_score from s where replenishment_score < 50
union all select 'opportunity', 'waste_diversion', diversion_score from s where diversion_score < 75)""")
def k20(b: Bound):
    return K.k20_strengths(b.combined())


_OPS = f"""
with y as (select year(date) as year, {mean_sql('pue')} as pue, {mean_sql('cfe_pct')} as cfe,
                  avg(cast(water_consumption_gallons as double) / nullif(cast(electricity_mwh as double), 0)) as w,
                  {mean_sql('waste_diversion_pct')} as div, cast(sum(electricity_mwh) as double) as mwh,
                  cast(sum(water_consumption_gallons) as double) as water from combined where year(date) <= {LAST_FULL_YEAR} group by 1),
e as (select min(year) as y0, max(year) as y1, arg_min(pue, year) as p0, arg_max(pue, year) as p1, arg_min(cfe, year) as c0, arg_max(cfe, year) as c1,
             arg_min(w, year) as w0, arg_max(w, year) as w1, arg_min(div, year) as d0, arg_max(div, year) as d1, arg_max(mwh, year) as mwh from y)"""


@query("k21_yearly_operations", _OPS + """
select cast(year as bigint) as year, pue, cfe as cfe_pct, round(w, 6) as water_per_mwh, div as waste_diversion_pct, mwh as electricity_mwh, water as water_consumption_gallons from y""",
       digits={"water_per_mwh": 6})
def k21_years(b: Bound):
    return K.yearly_operations(b.combined(), LAST_FULL_YEAR)


@query("k21_improvements", _OPS + """
select cast(y0 as bigint) as first_year, cast(y1 as bigint) as last_year, cast(y1 - y0 as bigint) as years_span, p0 as first_pue, p1 as last_pue,
       p0 - p1 as pue_improvement, (p0 - p1) * 100 / p0 as pue_pct, c1 - c0 as cfe_improvement, round(w0 - w1, 6) as water_improvement,
       round((w0 - w1) * 100 / w0, 6) as water_pct, d1 - d0 as diversion_improvement, mwh as last_electricity_mwh from e""",
       digits={"water_improvement": 6, "water_pct": 6})
def k21(b: Bound):
    return K.k21_improvements(b.combined(), LAST_FULL_YEAR).withColumns({
        # differences of equal means may carry a negative zero
        "water_improvement": F.round("water_improvement", 6) + 0.0, "water_pct": F.round("water_pct", 6) + 0.0,
    })


@query("k22_internal_benchmark", f"""
with p as (select facility_id, facility_name, {mean_sql('pue')} as pue, {mean_sql('cfe_pct')} as cfe,
                  avg(cast(water_consumption_gallons as double) / nullif(cast(electricity_mwh as double), 0)) as w, {mean_sql('electricity_mwh')} as mwh
           from combined where facility_type = 'Data Center' group by 1, 2),
b as (select * from p order by pue, facility_name limit 1), w as (select * from p order by pue desc, facility_name limit 1)
select b.facility_name as best_facility_name, b.pue as best_pue, b.cfe as best_cfe_pct, round(b.w, 6) as best_water_per_mwh, b.mwh as best_electricity_mwh,
       w.facility_name as worst_facility_name, w.pue as worst_pue, w.cfe as worst_cfe_pct, round(w.w, 6) as worst_water_per_mwh, w.mwh as worst_electricity_mwh,
       w.pue - b.pue as gap, w.mwh * ((w.pue - b.pue) / w.pue) * 70 / 1000 * 12 as potential_kusd_per_year from b, w""",
       digits={"best_water_per_mwh": 6, "worst_water_per_mwh": 6})
def k22(b: Bound):
    return K.k22_benchmark(b.combined())


@query("k23_pue_projection", _OPS + f""",
f as (select regr_slope(pue, year) as s, regr_intercept(pue, year) as i from y),
g as (select p1, i + s * {HORIZON} as pr, s, mwh from f, e)
select p1 as current_pue, round(pr, 8) as projected_pue, round(p1 - pr, 8) as improvement, round(-s, 9) as annual_rate,
       case when pr < 1.08 then 'exceeds best practice' when pr < 1.10 then 'industry-leading' else 'accelerate' end as band,
       round(case when p1 > pr then mwh * ((p1 - pr) / p1) end, 2) as energy_saved_mwh,
       round(case when p1 > pr then mwh * ((p1 - pr) / p1) * 70 / 1000 end, 3) as cost_savings_kusd,
       round(case when p1 > pr then mwh * ((p1 - pr) / p1) * 70 / 1000 * 6 / 2 end, 3) as cumulative_kusd,
       round(case when p1 > pr then mwh * ((p1 - pr) / p1) * 70 / 1000 * 2.5::double end, 3) as investment_kusd from g""",
       digits={"projected_pue": 8, "improvement": 8, "annual_rate": 9, "energy_saved_mwh": 2, "cost_savings_kusd": 3,
               "cumulative_kusd": 3, "investment_kusd": 3})
def k23(b: Bound):
    return K.k23_pue_projection(b.combined(), LAST_FULL_YEAR, HORIZON)


@query("k24_filtered_totals", """
select region, facility_type, count(*) as records, cast(sum(total_emissions) as double) as total_emissions
from combined where region in ('EU', 'APAC') and facility_type in ('Data Center', 'Office')
     and date between date '1996-03-01' and date '1999-10-15' and year(date) in (1996, 1997, 1999) group by 1, 2""")
def k24(b: Bound):
    start, end = date(1996, 3, 1), date(1999, 10, 15)
    kept = apply_filters(
        b.combined(start, end), regions=["EU", "APAC"], types=["Data Center", "Office"],
        years=[1996, 1997, 1999], start=start, end=end,
    )
    return kept.groupBy("region", "facility_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum("total_emissions").alias("total_emissions")
    )


@query("k25_data_coverage", """
select count(*) as records, count(distinct facility_id) as facilities, count(distinct date) as months from combined""")
def k25(b: Bound):
    return K.k25_coverage(b.emissions())


@query("k26_stacked_scopes", """
select strftime(date, '%Y-%m') as month, cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2,
       cast(sum(scope3_tonnes) as double) as scope3 from emissions where year(date) = 1998 group by 1""")
def k26(b: Bound):
    return K.k26_stacked_scopes(b.meters(FIRST, LAST), YEAR)
