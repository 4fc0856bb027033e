"""Aggregates, windows, limits and reshaping as registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.catalog.kpis import change_sql, mean_sql
from scopeledger.catalog.registry import query
from scopeledger.functions import aggregates as Ag
from scopeledger.functions.scalars import total_emissions, year_of
from scopeledger.operators import aggregates as A
from scopeledger.operators import ranking as Rk
from scopeledger.operators import reshape as Rs
from scopeledger.operators import topk as Tk
from scopeledger.operators import windows as Wn
from scopeledger.operators.calendar import missing_months, resample_monthly
from scopeledger.operators.filters import in_year
from scopeledger.operators.joins import enrich, null_safe_join
from scopeledger.plans import finance as R
from scopeledger.sources.binding import YEAR, Bound

FIRST, LAST = date(YEAR, 1, 1), date(YEAR, 12, 1)


def monthly(b: Bound) -> DataFrame:
    return b.meters().groupBy("date").agg(F.sum(total_emissions()).alias("t"))


def by_facility(b: Bound) -> DataFrame:
    return b.meters(facility=True, unit=None).groupBy("facility_id").agg(F.sum(total_emissions()).alias("t"))


_M = "m as (select date, sum(total_emissions) as t from emis group by 1)"
_F = "s as (select facility_id, sum(total_emissions) as t from emis group by 1)"
_FM = "fm as (select facility_id, date, sum(total_emissions) as t from emis group by 1, 2)"


def facility_months(b: Bound) -> DataFrame:
    return b.emissions().select("facility_id", "date", total_emissions().alias("t"))


# -- aggregates -------------------------------------------------------------------


@query("a01_scope_totals", """
select cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2,
       cast(sum(scope3_tonnes) as double) as scope3, cast(sum(total_emissions) as double) as total from emis""")
def a01(b: Bound):
    return A.scope_totals(b.meters(unit="year"))


@query("a02_grouped_sums", """
select region, facility_type, cast(year(date) as bigint) as year, cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2,
       cast(sum(scope3_tonnes) as double) as scope3, cast(sum(total_emissions) as double) as total from combined group by 1, 2, 3""")
def a02(b: Bound):
    return A.scope_totals(b.combined(), ["region", "facility_type", year_of("date").alias("year")])


@query("a03_distinct_counts", "select date, count(distinct facility_id) as facilities from emissions group by 1")
def a03(b: Bound):
    return b.emissions().groupBy("date").agg(F.count_distinct("facility_id").alias("facilities"))


@query("a03_distinct_sketches", """
with l as (select year(date) as year, month(date) as month, grouping(year(date)) + grouping(month(date)) as level, count(distinct facility_id) as facilities, count(*) as row_count
           from emissions group by rollup (year(date), month(date)))
select level, year, month, row_count, facilities, true as within_bound from l""")
def a03_sketches(b: Bound):
    """Distinct facilities by month, year and in all: exact, and whether the merged sketches are within their error bound."""
    dated = b.emissions().select("facility_id", year_of("date").alias("year"), F.month("date").alias("month"))
    level = F.grouping("year").cast("int") + F.grouping("month").cast("int")
    exact = dated.rollup("year", "month").agg(F.count_distinct("facility_id").alias("facilities"), level.alias("level"))
    sketched = A.sketched_by_level(dated, "facility_id", ["year", "month"])
    both = null_safe_join(exact, sketched, ["level", "year", "month"])
    close = F.abs(F.col("estimate") - F.col("facilities")) <= F.col("facilities") * Ag.SKETCH_ERROR + 1
    return both.select("level", "year", "month", "row_count", "facilities", close.alias("within_bound"))


@query("a04_mean_skips_null", f"select facility_type, {mean_sql('pue')} as pue, {mean_sql('cfe_pct')} as cfe_pct from combined group by 1")
def a04(b: Bound):
    return b.combined().groupBy("facility_type").agg(Ag.mean("pue").alias("pue"), Ag.mean("cfe_pct").alias("cfe_pct"))


@query("a05_conditional_counts", """
select cast(year(date) as bigint) as year, sum(case when renewable_pct < 50 then 1 else 0 end)::bigint as low, sum(case when scope1_tonnes > 200 then 1 else 0 end)::bigint as large
from emissions group by 1""")
def a05(b: Bound):
    return b.emissions().groupBy(year_of("date").alias("year")).agg(
        Ag.count_where(F.col("renewable_pct") < 50).alias("low"), Ag.count_where(F.col("scope1_tonnes") > 200).alias("large")
    )


@query("a06_a07_ratio_kinds", """
select region, cast(sum(scope2_market_tonnes) as double) / cast(sum(electricity_mwh) as double) as ratio_of_sums,
       round(avg(cast(scope2_market_tonnes as double) / nullif(cast(electricity_mwh as double), 0)), 6) as mean_of_ratios from combined group by 1""",
       digits={"mean_of_ratios": 6})
def a06(b: Bound):
    return b.combined().groupBy("region").agg(
        Ag.ratio_of_sums("scope2_market_tonnes", "electricity_mwh").alias("ratio_of_sums"),
        Ag.mean_of_ratios("scope2_market_tonnes", "electricity_mwh").alias("mean_of_ratios"),
    )


@query("a08_rollup_levels", """
with f as (select year(date) as y, region, facility_type, total_emissions from combined)
select coalesce(case when grouping(y) = 1 then 'TOTAL' end, cast(y as varchar)) as year, case when grouping(region) = 1 then 'All Types' else region end as region,
       cast(grouping(y) + grouping(region) as bigint) as level, cast(sum(total_emissions) as double) as total from f group by rollup(y, region)""")
def a08(b: Bound):
    rows = b.combined().select(year_of("date").cast("string").alias("year"), "region", "total_emissions")
    return A.rollup_report(rows, ["year", "region"], [F.sum("total_emissions").alias("total")])


@query("a09_mean_of_monthly_sums", f"""
with q as (select region, date, sum(scope1_tonnes) as s1, sum(scope2_market_tonnes) as s2 from combined group by 1, 2)
select region, {mean_sql('s1')} as scope1_tonnes, {mean_sql('s2')} as scope2_market_tonnes from q group by 1""")
def a09(b: Bound):
    return A.mean_of_period_sums(b.combined(), ["region"], "date", ["scope1_tonnes", "scope2_market_tonnes"])


@query("a10_monthly_resample", f"""
with r as (select facility_id, date, sum(scope1_tonnes) as s, {mean_sql('renewable_pct')} as p from emissions where (year(date) * 12 + month(date) + facility_id) % 5 <> 0 group by 1, 2),
sp as (select facility_id, cast(unnest(generate_series(min(date), max(date), interval 1 month)) as date) as date from r group by 1)
select sp.facility_id, sp.date, coalesce(cast(s as double), 0) as scope1, p as renewable from sp left join r on r.facility_id = sp.facility_id and r.date = sp.date""")
def a10(b: Bound):
    kept = b.emissions().filter((F.year("date") * 12 + F.month("date") + F.col("facility_id")) % 5 != 0)
    return resample_monthly(kept, "date", {"scope1": ("sum", "scope1_tonnes"), "renewable": ("mean", "renewable_pct")}, ["facility_id"])


@query("a11_metric_aggregates", f"""
select region, {mean_sql('pue')} as pue, cast(sum(water_consumption_gallons) as double) as water from combined group by 1""")
def a11(b: Bound):
    return b.combined().groupBy("region").agg(
        A.metric_agg("mean", "pue").alias("pue"), A.metric_agg("sum", "water_consumption_gallons").alias("water")
    )


@query("a12_first_last", f"""
with {_FM}, e as (select facility_id, arg_min(t, date) as a, arg_max(t, date) as z from fm group by 1)
select facility_id, cast(a as double) as first_value, cast(z as double) as last_value, cast(z - a as double) as change, {change_sql('z', 'a')} as pct_change from e""")
def a12(b: Bound):
    return A.first_last(facility_months(b), "t", "date", ["facility_id"])


@query("a13_head_tail", f"""
with {_FM}, r as (select *, row_number() over (partition by facility_id order by date) as u, row_number() over (partition by facility_id order by date desc) as d,
                         count(*) over (partition by facility_id) as n from fm)
select facility_id, cast(sum(case when u <= 12 then t end) as double) as first_t, cast(sum(case when d <= 12 then t end) as double) as last_t from r where n >= 12 group by 1""")
def a13(b: Bound):
    return A.head_tail(facility_months(b), {"t": "sum"}, "date", 12, ["facility_id"])


@query("a14_extreme_rows", f"""
with {_F}, f as (select facility_type, facility_name, cast(t as double) as t, row_number() over (partition by facility_type order by s.t desc, facility_name) as n
                 from s join facilities x on s.facility_id = x.facility_id) select facility_type, facility_name, t from f where n = 1""")
def a14(b: Bound):
    named = enrich(by_facility(b), b.facilities(), "facility_id")
    return A.arg_extreme(named, "t", ["facility_name"], "max", ["facility_type"])


@query("a15_linear_trend", f"""
with {_FM}, x as (select facility_id, cast(t as double) as t, row_number() over (partition by facility_id order by date) - 1 as i from fm)
select facility_id, round(regr_slope(t, i), 4) as slope, round(regr_intercept(t, i), 3) as intercept, cast(count(*) as bigint) as n from x group by 1""",
       digits={"slope": 4, "intercept": 3})
def a15(b: Bound):
    return A.linear_trend(facility_months(b), "t", order="date", p=["facility_id"])


@query("a16_weighted_mean", """
select region, cast(sum(cast(pue as decimal(10,6)) * cast(electricity_mwh as decimal(18,2))) as double) / cast(sum(electricity_mwh) as double) as weighted_pue
from combined where pue is not null group by 1""")
def a16(b: Bound):
    return b.combined().filter(F.col("pue").isNotNull()).groupBy("region").agg(
        Ag.weighted_mean("pue", "electricity_mwh").alias("weighted_pue")
    )


@query("a17_sigma_band", f"""
with {_FM}, x as (select *, row_number() over (partition by facility_id order by date desc) as n from fm)
select facility_id, round(1.96::double * stddev_pop(cast(t as double)), 3) as half_width from x where n <= 12 group by 1""", digits={"half_width": 3})
def a17(b: Bound):
    return A.sigma_band(facility_months(b), "t", "date", p=["facility_id"])


@query("a18_latest_slice", """
select facility_id, date, cast(scope1_tonnes as double) as scope1_tonnes from emissions where date = (select max(date) from emissions)""")
def a18(b: Bound):
    return A.latest_slice(b.emissions()).select("facility_id", "date", "scope1_tonnes")


@query("a19_group_sizes", "select facility_id, facility_type, count(*) over (partition by facility_type) as group_size from facilities")
def a19(b: Bound):
    return A.with_group_size(b.facilities(), ["facility_type"]).select("facility_id", "facility_type", "group_size")


@query("a20_composite_score", """
select facility_id, date, (cast(cfe_pct as double) + cast(water_replenishment_pct as double) + cast(waste_diversion_pct as double)) / 3 as score from operations""")
def a20(b: Bound):
    shares = ["cfe_pct", "water_replenishment_pct", "waste_diversion_pct"]
    scores = b.operations().select("facility_id", "date", *[F.col(c).cast("double").alias(c) for c in shares])
    return scores.select("facility_id", "date", A.composite(shares).alias("score"))


@query("a21_rows_and_facilities", "select region, count(*) as row_count, count(distinct facility_id) as distinct_count from combined group by 1")
def a21(b: Bound):
    return b.combined().groupBy("region").agg(*A.row_and_distinct_count("facility_id"))


# -- windows ------------------------------------------------------------------------


def _rows_mean(before: int, after: int) -> str:
    frame = f"rows between {before} preceding and {after} following" if after else f"rows between {before} preceding and current row"
    over = f"over (partition by facility_id order by date {frame})"
    return f"cast(sum(t) {over} as double) / count(t) {over}"


@query("w01_w02_moving_averages", f"""
with {_FM} select facility_id, date, {_rows_mean(2, 0)} as ma3, {_rows_mean(5, 0)} as ma6 from fm""")
def w01(b: Bound):
    df = Wn.moving_average(facility_months(b), "t", "date", 2, p=["facility_id"], out="ma3")
    return Wn.moving_average(df, "t", "date", 5, p=["facility_id"], out="ma6").drop("t")


@query("w03_strict_moving_average", f"""
with {_FM} select facility_id, date, case when count(t) over (partition by facility_id order by date rows between 2 preceding and current row) = 3
   then {_rows_mean(2, 0)} end as ma3 from fm""")
def w03(b: Bound):
    return Wn.moving_average(facility_months(b), "t", "date", 2, strict=True, p=["facility_id"], out="ma3").drop("t")


@query("w03_calendar_moving_average", f"""
with {_FM}, x as (select *, year(date) * 12 + month(date) as k from fm)
select facility_id, date, cast(sum(t) over w as double) / count(t) over w as ma3 from x
window w as (partition by facility_id order by k range between 2 preceding and current row)""")
def w03_calendar(b: Bound):
    return Wn.moving_average(facility_months(b), "t", "date", 2, p=["facility_id"], mode="calendar", out="ma3").drop("t")


_CHANGE = """cast(t as double) as t, cast(p as double) as prior_t, cast(t - p as double) as change,
       (cast(t as double) - cast(p as double)) / nullif(cast(p as double), 0) * 100 as pct_change"""


@query("w04_year_over_year_rows", f"""
with {_FM}, l as (select *, lag(t, 12) over (partition by facility_id order by date) as p from fm) select facility_id, date, {_CHANGE} from l""")
def w04(b: Bound):
    return Wn.period_change(facility_months(b), "t", "date", 12, ["facility_id"], "rows")


@query("w04_year_over_year_calendar", f"""
with {_FM}, l as (select a.*, q.t as p from fm a left join fm q on q.facility_id = a.facility_id and q.date = a.date - interval 1 year)
select facility_id, date, {_CHANGE} from l""")
def w04_calendar(b: Bound):
    return Wn.period_change(facility_months(b), "t", "date", 12, ["facility_id"])


@query("w05_direction", f"""
with {_FM}, l as (select *, lag(t) over (partition by facility_id order by date) as p from fm)
select facility_id, date, case when t > p then 'Increasing' when t < p then 'Decreasing' else 'Stable' end as direction from l""")
def w05(b: Bound):
    return Wn.direction(facility_months(b), "t", "date", ["facility_id"]).drop("t")


@query("w06_w07_rank_and_quartile", f"""
with {_F} select facility_id, cast(t as double) as t, rank() over (order by t) as rank, ntile(4) over (order by t, facility_id) as quartile from s""")
def w06(b: Bound):
    return Rk.rank_quartile(by_facility(b), "t", ["facility_id"])


@query("w06_ranged_rank_and_quartile", """
with r as (select facility_id, date, cast(round(cast(scope1_tonnes as decimal(18,2)), -1) as double) as v from emissions)
select facility_id, date, v, rank() over (order by v desc) as rank, ntile(7) over (order by v desc, facility_id, date) as quartile from r""")
def w06_ranged(b: Bound):
    """The many-task path, with ties that cross ranges."""
    coarse = b.emissions().select("facility_id", "date", F.round("scope1_tonnes", -1).cast("double").alias("v"))
    return Rk.rank_quartile(coarse, "v", ["facility_id", "date"], asc=False, n=7, single_task_rows=1000)


@query("w08_w09_pareto", f"""
with {_F} select facility_id, cast(t as double) as t, rank() over (order by t desc) as rank, cast(t as double) * 100 / cast(sum(t) over () as double) as share_pct,
   cast(sum(t) over (order by t desc, facility_id rows unbounded preceding) as double) * 100 / cast(sum(t) over () as double) as cumulative_pct from s""")
def w08(b: Bound):
    return Rk.pareto(by_facility(b), "t", ["facility_id"])


@query("w08_ranged_pareto_by_region", """
with r as (select region, facility_id, date, scope1_tonnes as v from combined)
select region, facility_id, date, cast(v as double) as v, rank() over (partition by region order by v desc) as rank,
       cast(v as double) * 100 / cast(sum(v) over (partition by region) as double) as share_pct,
       cast(sum(v) over (partition by region order by v desc, facility_id, date rows unbounded preceding) as double) * 100 / cast(sum(v) over (partition by region) as double) as cumulative_pct from r""")
def w08_ranged(b: Bound):
    rows = b.combined().select("region", "facility_id", "date", F.col("scope1_tonnes").alias("v"))
    return Rk.pareto(rows, "v", ["facility_id", "date"], ["region"], single_task_rows=700)


@query("w09_share_of_group", f"""
with {_F} select s.facility_id, region, cast(t as double) as t, cast(t as double) * 100 / cast(sum(t) over (partition by region) as double) as share_pct
from s join facilities f on s.facility_id = f.facility_id""")
def w09(b: Bound):
    named = enrich(by_facility(b), b.facilities().select("facility_id", "region"), "facility_id")
    return Wn.share_of_total(named, "t", ["region"])


@query("w10_w12_decomposition_by_facility", f"""
with {_FM}, x as (select facility_id, date, cast(t as double) as y, {_rows_mean(6, 6)} as trend,
     cast(sum(t) over (partition by facility_id, month(date)) as double) / count(t) over (partition by facility_id, month(date)) as s,
     cast(sum(t) over (partition by facility_id) as double) / count(t) over (partition by facility_id) as o from fm),
z as (select *, lag(trend) over (partition by facility_id order by date) as p from x)
select facility_id, date, trend, s - o as seasonal, y - trend as detrended, (y - trend) - (s - o) as residual,
       case when trend > p then 'Increasing' when trend < p then 'Decreasing' else 'Stable' end as trend_direction from z""")
def w10(b: Bound):
    return Wn.decompose(facility_months(b), "t", "date", p=["facility_id"]).drop("t")


@query("w13_yearly_change", f"""
with y as (select facility_id, year(date) as year, sum(total_emissions) as t from emis group by 1, 2),
l as (select *, lag(t) over (partition by facility_id order by year) as p from y)
select facility_id, cast(year as bigint) as year, {_CHANGE} from l""")
def w13(b: Bound):
    yearly = b.emissions().groupBy("facility_id", year_of("date").alias("year")).agg(F.sum(total_emissions()).alias("t"))
    return Wn.period_change(yearly, "t", "year", 1, ["facility_id"], "rows")


@query("w14_last_against_13th_from_end", f"""
with {_FM}, x as (select *, row_number() over (partition by facility_id order by date desc) as n from fm),
e as (select facility_id, max(case when n = 1 then date end) as date, max(case when n = 1 then t end) as t, max(case when n = 13 then t end) as p from x group by 1)
select facility_id, date, cast(t as double) as t, cast(p as double) as prior_t, {change_sql('t', 'p')} as pct_change from e""")
def w14(b: Bound):
    return Wn.year_ago_of_last(facility_months(b), "t", "date", 12, ["facility_id"])


@query("w15_time_index", f"with {_FM} select facility_id, date, row_number() over (partition by facility_id order by date) - 1 as idx from fm")
def w15(b: Bound):
    return Wn.with_index(facility_months(b), "date", ["facility_id"]).drop("t")


# -- limits ---------------------------------------------------------------------------


@query("t01_latest_months", f"with {_M} select date, cast(t as double) as t from m order by date desc limit 24")
def t01(b: Bound):
    return Tk.latest_n(monthly(b), "date", 24)


@query("t02_top_facilities", f"with {_F} select facility_id, cast(t as double) as t from s order by s.t desc, facility_id limit 10")
def t02(b: Bound):
    return Tk.top_k(by_facility(b), "t", ["facility_id"], 10)


@query("t02_top_by_region", f"""
with {_F}, r as (select s.facility_id, region, cast(t as double) as t, row_number() over (partition by region order by s.t desc, s.facility_id) as n
                 from s join facilities f on s.facility_id = f.facility_id) select facility_id, region, t from r where n <= 3""")
def t02_region(b: Bound):
    named = enrich(by_facility(b), b.facilities().select("facility_id", "region"), "facility_id")
    return Tk.top_k(named, "t", ["facility_id"], 3, ["region"])


@query("t03_top3_share", f"""
with {_F}, h as (select sum(t) as h from (select t from s order by t desc, facility_id limit 3)), w as (select sum(t) as w from s)
select cast(h as double) as top_value, cast(w as double) as total_value, cast(h as double) * 100 / cast(w as double) as top_share_pct from h, w""")
def t03(b: Bound):
    return Tk.top_share(by_facility(b), "t", ["facility_id"], 3)


@query("t04_latest_month", f"with {_M} select date, cast(t as double) as t from m where date = (select max(date) from m)")
def t04(b: Bound):
    return Tk.latest_n(monthly(b), "date", 1)


@query("t05_totals_last", """
select case when grouping(region) = 1 then 'TOTAL' else region end as region, case when grouping(facility_type) = 1 then 'All Types' else facility_type end as facility_type,
       cast(sum(total_emissions) as double) as total from combined where year(date) = 1998 group by rollup(region, facility_type)""")
def t05(b: Bound):
    rows = in_year(b.combined(FIRST, LAST), YEAR)
    report = A.rollup_report(rows, ["region", "facility_type"], [F.sum("total_emissions").alias("total")])
    return A.totals_last(report, ["region", "facility_type"]).drop("level")


@query("t06_mixed_order", """
select cast(year(date) as bigint) as year, region, cast(sum(scope1_tonnes) as double) as scope1 from combined group by 1, 2""")
def t06(b: Bound):
    yearly = b.combined().groupBy(year_of("date").alias("year"), "region").agg(F.sum("scope1_tonnes").alias("scope1"))
    return yearly.orderBy(F.col("year").desc(), "region")


@query("t07_first_and_last_n", f"""
with {_FM}, r as (select *, row_number() over (partition by facility_id order by date) as u, row_number() over (partition by facility_id order by date desc) as d from fm)
select facility_id, date, 'head' as part, cast(t as double) as t from r where u <= 3 union all select facility_id, date, 'tail', cast(t as double) from r where d <= 3""")
def t07(b: Bound):
    months = facility_months(b)
    head = Tk.first_n(months, "date", 3, ["facility_id"]).withColumn("part", F.lit("head"))
    return head.unionByName(Tk.latest_n(months, "date", 3, ["facility_id"]).withColumn("part", F.lit("tail")))


# -- reshape ------------------------------------------------------------------------------


@query("u03_scopes_as_rows", """
with y as (select year(date) as year, cast(sum(scope1_tonnes) as double) as s1, cast(sum(scope2_market_tonnes) as double) as s2, cast(sum(scope3_tonnes) as double) as s3 from emissions group by 1)
select cast(year as bigint) as year, 'Scope 1' as scope, s1 as tonnes from y union all select year, 'Scope 2', s2 from y union all select year, 'Scope 3', s3 from y""")
def u03(b: Bound):
    yearly = A.scope_totals(b.meters(unit="year"), [year_of("date").alias("year")])
    return Rs.unpivot_report(yearly, ["year"], {"scope1": "Scope 1", "scope2": "Scope 2", "scope3": "Scope 3"}, "scope", "tonnes")


@query("u04_summary_rows", f"""
with t as (select cast(sum(total_emissions) as double) as t, cast(sum(scope1_tonnes) as double) as s1, {mean_sql('renewable_pct')} as r from emis)
select 'Total Emissions' as metric, t as value from t union all select 'Scope 1', s1 from t union all select 'Avg Renewable %', r from t""")
def u04(b: Bound):
    one = b.emissions().agg(
        F.sum(total_emissions()).cast("double").alias("t"), F.sum("scope1_tonnes").cast("double").alias("s1"),
        Ag.mean("renewable_pct").alias("r"),
    )
    return Rs.stack_rows(one, [], ["metric", "value"], [
        [F.lit("Total Emissions"), F.col("t")], [F.lit("Scope 1"), F.col("s1")], [F.lit("Avg Renewable %"), F.col("r")],
    ])


@query("u05_payback_matrix", f"""
with o as (select {mean_sql('pue')} as pue, cast(sum(electricity_mwh) as double) / cast(count(distinct date) as double) * 12 as mwh from combined
           where electricity_mwh is not null and pue is not null and energy_cost_usd is not null and facility_type = 'Data Center'),
s as (select mwh * (pue - 1.08::double) as saved, 0.5::double + j * (1.5::double / 19) as capital from o, (select unnest(range(20)) as j))
select round(capital, 4) as capital_musd, """ + ", ".join(
    f"round(case when saved * (40 + {i} * (80::double / 19)) / 1000 > 0 then capital * 1000 / (saved * (40 + {i} * (80::double / 19)) / 1000) else 999 end, 6) as price_{i}"
    for i in range(20)) + " from s", digits={f"price_{i}": 6 for i in range(20)})
def u05(b: Bound):
    """Capital by price matrix of the fleet: rows capital, one column per price."""
    saved = R.pue_base(R.base_slice(b.combined())).select(
        (F.col("electricity_mwh") * (F.col("pue") - 1.08)).alias("energy_saved_mwh")
    )
    prices, capitals = R.default_price_grid(b.spark)
    grid = R.payback_grid(saved, prices, capitals)
    steps = [round(40 + i * 80 / 19, 4) for i in range(20)]
    rounded = grid.select(F.round("capital_musd", 4).alias("capital_musd"), F.round("energy_price", 4).alias("price"), "payback_years")
    return Rs.matrix(rounded, "capital_musd", "price", "payback_years", steps).withColumnsRenamed(
        {str(s): f"price_{i}" for i, s in enumerate(steps)}
    )


@query("u06_gap_months", """
with r as (select facility_id, date from emissions where (year(date) * 12 + month(date) + facility_id) % 5 <> 0),
sp as (select facility_id, cast(unnest(generate_series(min(date), max(date), interval 1 month)) as date) as date from r group by 1)
select * from sp except select * from r""")
def u06(b: Bound):
    kept = b.emissions().filter((F.year("date") * 12 + F.month("date") + F.col("facility_id")) % 5 != 0)
    return missing_months(kept, "date", ["facility_id"])
