"""Reports, views and extracts as registered queries."""

from __future__ import annotations

from datetime import date

from scopeledger.catalog.registry import query
from scopeledger.plans import reports as R
from scopeledger.sources.binding import FROM_YEAR, YEAR, Bound

FIRST, LAST = date(YEAR, 1, 1), date(YEAR, 12, 1)


@query("q01_monthly_trend", """
with m as (select strftime(date, '%Y-%m') as month, sum(scope1_tonnes) s1, sum(scope2_market_tonnes) s2,
                  sum(scope3_tonnes) s3, sum(total_emissions) t from emis group by 1)
select month, cast(round(s1, 0) as double) as scope1, cast(round(s2, 0) as double) as scope2,
       cast(round(s3, 0) as double) as scope3, cast(round(t, 0) as double) as total,
       round(cast(sum(t) over w3 as double) / count(*) over w3, 0) as moving_avg_3m,
       round(cast(sum(t) over w6 as double) / count(*) over w6, 0) as moving_avg_6m
from m window w3 as (order by month rows between 2 preceding and current row),
              w6 as (order by month rows between 5 preceding and current row)
order by month desc limit 24""")
def q01(b: Bound):
    return R.q01_trend(b.meters())


_YOY = """
m as (select year(date) as year, month(date) as month, sum(total_emissions) as t from emis
      where year(date) >= {since} group by 1, 2),
l as (select *, lag(t, 12) over (order by year, month) as p from m)
select cast(year as bigint) as year, cast(month as bigint) as month, cast(round(t, 0) as double) as current_emissions,
       cast(round(p, 0) as double) as prior_year_emissions, cast(round(t - p, 0) as double) as absolute_change,
       round((cast(t as double) - cast(p as double)) / nullif(cast(p as double), 0) * 100, 1) + 0.0 as pct_change
from l where year >= 1998 order by 1, 2"""


@query("q02_year_over_year", "with " + _YOY.format(since=1998))
def q02(b: Bound):
    return R.q02_yoy(b.meters(start=date(FROM_YEAR, 1, 1)), FROM_YEAR)


@query("q02_year_over_year_full_history", "with " + _YOY.format(since=1997))
def q02_full(b: Bound):
    return R.q02_yoy(b.meters(start=date(FROM_YEAR - 1, 1, 1)), FROM_YEAR, filter_first=False, mode="calendar")


@query("q03_scope3_pareto", """
with s as (select category_id, category_name, description,
                  round(cast(t as double) * (typical_pct_of_scope3 / 100), 0) as estimated_tonnes
           from categories, (select sum(scope3_tonnes) as t from emissions where year(date) = 1998))
select cast(category_id as bigint) as category_id, category_name, description, estimated_tonnes,
       rank() over (order by estimated_tonnes desc) as rank,
       round(estimated_tonnes * 100.0 / sum(estimated_tonnes) over (), 1) as pct_of_scope3,
       round(sum(estimated_tonnes) over (order by estimated_tonnes desc, category_id rows unbounded preceding) * 100.0
             / sum(estimated_tonnes) over (), 1) as cumulative_pct
from s""")
def q03(b: Bound):
    return R.q03_pareto(b.meters(FIRST, LAST, unit="year"), b.categories(), YEAR)


@query("q04_target_progress", """
with c as (select year(date) as year, sum(scope1_tonnes + scope2_market_tonnes) as a, sum(scope3_tonnes) as s3
           from emissions group by 1),
t as (select * from targets where scope = 'Scope 1 & 2'),
j as (select *, baseline_emissions - ((baseline_emissions - target_emissions) * (year - baseline_year)
                                      / (target_year - baseline_year)) as path from c, t)
select cast(year as bigint) as year, cast(round(a, 0) as double) as scope12_actual, cast(round(s3, 0) as double) as scope3_actual,
       cast(round(a + s3, 0) as double) as total_actual, round(baseline_emissions, 0) as baseline,
       round(target_emissions, 0) as target, round(path, 0) as trajectory,
       round((baseline_emissions - cast(a as double)) / nullif(baseline_emissions - target_emissions, 0) * 100, 1) as pct_progress,
       case when cast(a as double) <= path then 'On Track' else 'Behind Target' end as status
from j where year >= baseline_year""")
def q04(b: Bound):
    return R.q04_targets(b.meters(unit="year"), b.targets())


@query("q04_all_targets", """
with c as (select year(date) as year, sum(scope1_tonnes + scope2_market_tonnes) as s12, sum(scope3_tonnes) as s3
           from emissions group by 1),
l as (select 'Scope 1 & 2' as scope, year, s12 as a from c union all select 'Scope 3', year, s3 from c),
j as (select l.scope, year, cast(a as double) as a, a as d, baseline_emissions - ((baseline_emissions - target_emissions) * (year - baseline_year)
             / (target_year - baseline_year)) as path, baseline_year from l join targets t on l.scope = t.scope)
select scope, cast(year as bigint) as year, cast(round(d, 0) as double) as actual, round(path, 0) as trajectory,
       case when a <= path then 'On Track' else 'Behind Target' end as status
from j where year >= baseline_year""")
def q04_all(b: Bound):
    return R.q04_all_targets(b.meters(unit="year"), b.targets())


_INTENSITY = """
with m as (select e.facility_id, sum(total_emissions) as t, sum(revenue_millions) as r,
                  cast(sum(renewable_pct) as double) / count(renewable_pct) as ren
           from emis e join business b on e.facility_id = b.facility_id and e.date = b.date
           where year(e.date) = 1998 group by 1)"""


@query("q05_facility_intensity", _INTENSITY + """,
x as (select f.*, t, r, ren, round(cast(t as double) / nullif(cast(r as double), 0), 1) as emission_intensity
      from m join facilities f on m.facility_id = f.facility_id),
y as (select *, rank() over (order by emission_intensity) as rk, ntile(4) over (order by emission_intensity, facility_id) as q from x)
select facility_id, facility_name, region, facility_type, cast(round(t, 0) as double) as total_emissions,
       cast(round(r, 1) as double) as total_revenue, emission_intensity, round(ren, 0) as avg_renewable_pct,
       rk as intensity_rank, q as performance_quartile,
       case q when 1 then 'Top Performer' when 2 then 'Above Average' when 3 then 'Below Average'
              else 'Needs Improvement' end as performance_category from y""")
def q05(b: Bound):
    return R.q05_intensity(b.facilities(), b.emissions(FIRST, LAST), b.business(FIRST, LAST), YEAR)


_SUBTOTAL = """count(distinct f.facility_id) as facility_count,
       cast(round(sum(scope1_tonnes), 0) as double) as scope1_total, cast(round(sum(scope2_market_tonnes), 0) as double) as scope2_total,
       cast(round(sum(scope3_tonnes), 0) as double) as scope3_total, cast(round(sum(total_emissions), 0) as double) as total_emissions
from emis e join facilities f on e.facility_id = f.facility_id where year(e.date) = 1998"""


@query("q06_region_type_subtotals", f"""
select region, facility_type, {_SUBTOTAL} group by region, facility_type
union all select region, 'All Types', {_SUBTOTAL} group by region
union all select 'TOTAL', 'All Types', {_SUBTOTAL}""")
def q06(b: Bound):
    return R.q06_subtotals(b.facilities(), b.meters(FIRST, LAST, facility=True, unit="year"), YEAR)


_AUDIT = """
with d as (select count(*) as n,
    sum(case when scope1_tonnes is null then 1 else 0 end) as m1,
    sum(case when scope2_market_tonnes is null then 1 else 0 end) as m2,
    sum(case when scope3_tonnes is null then 1 else 0 end) as m3,
    sum(case when scope2_market_tonnes > scope2_location_tonnes then 1 else 0 end) as bad2,
    sum(case when scope1_tonnes < 0 or scope2_market_tonnes < 0 or scope3_tonnes < 0 then 1 else 0 end) as neg,
    sum(case when renewable_pct < 0 or renewable_pct > 100 then 1 else 0 end) as ren from emissions),
c as (select 'Total Records' as check_type, n as ok, n from d
      union all select 'Complete Scope 1', n - m1, n from d union all select 'Complete Scope 2', n - m2, n from d
      {extra} union all select 'Valid Scope 2 Values', n - bad2, n from d
      union all select 'No Negative Values', n - neg, n from d union all select 'Valid Renewable %', n - ren, n from d)
select check_type, cast(ok as bigint) as count, round(cast(ok * 100.0 as double) / n, 2) as pass_rate_pct from c"""


@query("q07_quality_audit", _AUDIT.format(extra=""))
def q07(b: Bound):
    return R.q07_audit(b.emissions())


@query("q07_quality_audit_with_scope3", _AUDIT.format(extra="union all select 'Complete Scope 3', n - m3, n from d"))
def q07_seven(b: Bound):
    return R.q07_audit(b.emissions(), with_scope3=True)


@query("q08_decomposition", """
with m as (select date, sum(total_emissions) as t from emis group by 1),
x as (select date, cast(t as double) as y,
      cast(sum(t) over (order by date rows between 6 preceding and 6 following) as double)
        / count(*) over (order by date rows between 6 preceding and 6 following) as trend,
      cast(sum(t) over (partition by month(date)) as double) / count(*) over (partition by month(date)) as s,
      cast(sum(t) over () as double) / count(*) over () as o, t from m),
z as (select *, lag(trend) over (order by date) as p from x)
select date, cast(round(t, 0) as double) as actual, round(trend, 0) as trend_component, round(s - o, 0) as seasonal_component,
       round(y - trend, 0) as detrended, round((y - trend) - (s - o), 0) as residual,
       case when trend > p then 'Increasing' when trend < p then 'Decreasing' else 'Stable' end as trend_direction
from z order by date desc limit 24""")
def q08(b: Bound):
    return R.q08_decompose(b.meters())


@query("q09_renewable_impact", """
select cast(year(e.date) as bigint) as year, region, count(distinct f.facility_id) as facility_count,
       round(cast(sum(renewable_pct) as double) / count(renewable_pct), 1) as avg_renewable_pct,
       cast(round(sum(scope2_location_tonnes), 0) as double) as scope2_location_total,
       cast(round(sum(scope2_market_tonnes), 0) as double) as scope2_market_total,
       cast(round(sum(scope2_location_tonnes - scope2_market_tonnes), 0) as double) as avoided_emissions,
       round(cast(sum(scope2_location_tonnes - scope2_market_tonnes) as double) / nullif(cast(sum(scope2_location_tonnes) as double), 0) * 100, 1) as avoided_emissions_pct,
       cast(round(sum(electricity_mwh), 0) as double) as total_electricity_mwh,
       round(cast(sum(cast(electricity_mwh as decimal(16,2)) * cast(renewable_pct as decimal(10,6))) as double) / 100, 0) as renewable_electricity_mwh
from emissions e join facilities f on e.facility_id = f.facility_id group by 1, 2""")
def q09(b: Bound):
    return R.q09_renewable(b.emissions(), b.facilities())


@query("q10_reduction_opportunities", """
with a as (select facility_id, cast(sum(total_emissions) as double) as t,
                  cast(sum(scope2_location_tonnes - scope2_market_tonnes) as double) as impact,
                  cast(sum(scope2_location_tonnes) as double) * 0.5::double as possible,
                  cast(sum(renewable_pct) as double) / count(renewable_pct) as pct,
                  cast(sum(scope1_tonnes) as double) * 0.2::double as s1, cast(sum(scope3_tonnes) as double) * 0.3::double as s3
           from emis where year(date) = 1998 group by 1)
select f.facility_id, facility_name, region, facility_type, round(t, 0) as current_emissions, round(pct, 0) as current_renewable_pct,
       round(possible - impact, 0) as renewable_opportunity, round(s1, 0) as scope1_opportunity, round(s3, 0) as scope3_opportunity,
       round((possible - impact) + s1 + s3, 0) as total_opportunity,
       round(((possible - impact) + s1 + s3) / nullif(t, 0) * 100, 1) as potential_reduction_pct
from a join facilities f on a.facility_id = f.facility_id order by total_opportunity desc, f.facility_id limit 10""")
def q10(b: Bound):
    return R.q10_opportunities(b.facilities(), b.emissions(FIRST, LAST), YEAR)


@query("v01_monthly_totals", """
select f.*, e.date, cast(year(e.date) as bigint) as year, strftime(e.date, '%Y-%m') as month,
       cast(scope1_tonnes as double) as scope1_tonnes, cast(scope2_location_tonnes as double) as scope2_location_tonnes,
       cast(scope2_market_tonnes as double) as scope2_market_tonnes, cast(scope3_tonnes as double) as scope3_tonnes,
       cast(total_emissions as double) as total_emissions, cast(renewable_pct as double) as renewable_pct,
       cast(revenue_millions as double) as revenue_millions,
       case when revenue_millions > 0 then cast(total_emissions as double) / cast(revenue_millions as double) end as emission_intensity
from emis e join facilities f on e.facility_id = f.facility_id
     left join business b on e.facility_id = b.facility_id and e.date = b.date""")
def v01(b: Bound):
    return R.v_monthly(b.facilities(), b.emissions(), b.business())


@query("v02_annual_summary", """
select cast(year(date) as bigint) as year, count(distinct facility_id) as facility_count, cast(sum(scope1_tonnes) as double) as total_scope1,
       cast(sum(scope2_location_tonnes) as double) as total_scope2_location, cast(sum(scope2_market_tonnes) as double) as total_scope2_market,
       cast(sum(scope3_tonnes) as double) as total_scope3, cast(sum(total_emissions) as double) as total_emissions,
       cast(sum(renewable_pct) as double) / count(renewable_pct) as avg_renewable_pct
from emis group by 1""")
def v02(b: Bound):
    return R.v_annual(b.emissions())


@query("v03_facility_rankings", _INTENSITY + """,
x as (select f.*, t, r, ren, case when r > 0 then cast(t as double) / cast(r as double) end as i
      from m join facilities f on m.facility_id = f.facility_id)
select facility_id, facility_name, region, facility_type, cast(t as double) as total_emissions, cast(r as double) as total_revenue,
       i as emission_intensity, ren as avg_renewable_pct, rank() over (order by i asc nulls last) as intensity_rank from x""")
def v03(b: Bound):
    return R.v_rankings(b.facilities(), b.emissions(FIRST, LAST), b.business(FIRST, LAST), YEAR)


@query("x01_emissions_extract", """
select e.date, f.*, cast(scope1_tonnes as double) as scope1_tonnes, cast(scope2_location_tonnes as double) as scope2_location_tonnes,
       cast(scope2_market_tonnes as double) as scope2_market_tonnes, cast(scope3_tonnes as double) as scope3_tonnes,
       cast(total_emissions as double) as total_emissions, cast(electricity_mwh as double) as electricity_mwh,
       cast(renewable_pct as double) as renewable_pct, cast(year(e.date) as bigint) as year, cast(month(e.date) as bigint) as month,
       strftime(e.date, '%Y-%m') as year_month, cast(revenue_millions as double) as revenue_millions, headcount, square_feet, server_count,
       cast(round(cast(cast(total_emissions as double) / nullif(cast(revenue_millions as double), 0) as decimal(38,8)), 2) as double) as intensity_per_revenue,
       cast(round(cast(cast(total_emissions as double) / nullif(headcount, 0) as decimal(38,8)), 2) as double) as intensity_per_employee
from emis e join facilities f on e.facility_id = f.facility_id
     left join business b on e.facility_id = b.facility_id and e.date = b.date""")
def x01(b: Bound):
    return R.x_emissions(b.facilities(), b.emissions(), b.business())


@query("x02_facilities_extract", "select * from facilities")
def x02(b: Bound):
    return R.x_facilities(b.facilities())


@query("x03_targets_extract", "select * from targets")
def x03(b: Bound):
    return R.x_targets(b.targets())


@query("x05_monthly_summary", """
select strftime(date, '%Y-%m') as year_month, cast(year(date) as bigint) as year, cast(month(date) as bigint) as month,
       count(distinct facility_id) as facilities_reporting, cast(sum(scope1_tonnes) as double) as total_scope1,
       cast(sum(scope2_market_tonnes) as double) as total_scope2, cast(sum(scope3_tonnes) as double) as total_scope3,
       cast(sum(total_emissions) as double) as total_emissions, cast(sum(electricity_mwh) as double) as total_electricity,
       cast(sum(renewable_pct) as double) / count(renewable_pct) as avg_renewable_pct
from emis group by 1, 2, 3""")
def x05(b: Bound):
    return R.x_monthly(b.emissions())


_DIM = """
select {dim}, strftime(e.date, '%Y-%m') as year_month, count(distinct e.facility_id) as facilities,
       cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2,
       cast(sum(scope3_tonnes) as double) as scope3, cast(sum(total_emissions) as double) as total_emissions
from emis e join facilities f on e.facility_id = f.facility_id group by 1, 2"""


@query("x06_regional_summary", _DIM.format(dim="region"))
def x06(b: Bound):
    return R.x_regional(b.facilities(), b.emissions())


@query("x07_facility_type_summary", _DIM.format(dim="facility_type"))
def x07(b: Bound):
    return R.x_by_type(b.facilities(), b.emissions())
