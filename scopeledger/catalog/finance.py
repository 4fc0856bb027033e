"""Investment models as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.catalog.kpis import mean_sql
from scopeledger.catalog.registry import query
from scopeledger.model import lookups as L
from scopeledger.operators.joins import enrich, literal_dim
from scopeledger.operators.windows import share_of_total
from scopeledger.plans import finance as R
from scopeledger.sources.binding import LAST_FULL_YEAR, Bound

FIRST_YEAR = 1995

BASE = "base as (select * from combined where electricity_mwh is not null and pue is not null and energy_cost_usd is not null)"


def base(b: Bound) -> DataFrame:
    return R.base_slice(b.combined())


def upgrades(b: Bound) -> DataFrame:
    """Three efficiency projects: default target, best practice, and a deeper cut."""
    return literal_dim(
        b.spark,
        [("default", None, 1.0, 70.0), ("best practice", 1.08, 1.0, 70.0), ("deep", 1.06, 2.5, 85.0)],
        "project STRING, target_pue DOUBLE, capital_musd DOUBLE, energy_price DOUBLE",
    )


_UPGRADES = """up as (select * from (values ('default', null, 1.0::double, 70.0::double), ('best practice', 1.08::double, 1.0::double, 70.0::double),
                      ('deep', 1.06::double, 2.5::double, 85.0::double)) t(project, target_pue, capital_musd, energy_price))"""


@query("r00_base_slice", f"""
with {BASE}
select facility_id, date, cast(electricity_mwh as double) as electricity_mwh, cast(pue as double) as pue,
       cast(energy_cost_usd as double) as energy_cost_usd from base""")
def r00(b: Bound):
    return base(b).select("facility_id", "date", "electricity_mwh", "pue", "energy_cost_usd")


def _pue_sql(by: str, months: str, scale: int) -> str:
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""{BASE}, {_UPGRADES},
o as (select {keys}{mean_sql('pue')} as pue, cast(sum(electricity_mwh) as double) / {months} * 12 as electricity_mwh,
             cast(sum(energy_cost_usd) as double) / {months} * 12 as energy_cost_kusd from base where facility_type = 'Data Center' {group}),
g as (select {keys}project, coalesce(target_pue::double, greatest(1.08::double, pue - 0.02::double)) as target_pue, capital_musd, energy_price,
             pue, electricity_mwh, energy_cost_kusd from o, up),
s as (select *, electricity_mwh * (pue - target_pue) as energy_saved_mwh,
             electricity_mwh * (pue - target_pue) * energy_price / 1000 as savings_kusd from g),
roi as (select {keys}project, target_pue, capital_musd, energy_price, pue, electricity_mwh, energy_cost_kusd, pue - target_pue as pue_reduction,
             (pue - target_pue) / pue * 100 as pue_reduction_pct, energy_saved_mwh, savings_kusd, energy_saved_mwh * 0.3::double as carbon_saved_t,
             case when savings_kusd > 0 then capital_musd * {scale} / savings_kusd else 999.0::double end as payback_years from s)"""


@query("r01_pue_roi_by_region", "with " + _pue_sql("region", "cast(count(distinct date) as double)", 1000) + " select * from roi")
def r01(b: Bound):
    return R.pue_roi(base(b), upgrades(b), ["region"])


@query("r01_pue_roi_compat", "with " + _pue_sql("", "12::double", 1) + " select * from roi")
def r01_compat(b: Bound):
    return R.pue_roi(base(b), upgrades(b), compat=True)


def _projects(b: Bound) -> DataFrame:
    return R.pue_roi(base(b), upgrades(b), ["region"]).select(
        "region", "project", "capital_musd", "savings_kusd", "energy_saved_mwh"
    )


_FLOWS = "with " + _pue_sql("region", "cast(count(distinct date) as double)", 1000) + """,
y as (select unnest(range(0, 11)) as year),
f as (select region, project, year, case when year = 0 then -capital_musd * 1000 else savings_kusd * pow(1.02::double, year) end as cash_flow from roi, y)"""


@query("r02_cash_flows", _FLOWS + """
select region, project, year, round(cash_flow, 4) as cash_flow,
       round(sum(cash_flow) over (partition by region, project order by year rows unbounded preceding), 4) as cumulative from f""",
       digits={"cash_flow": 4, "cumulative": 4})
def r02_flows(b: Bound):
    return R.cash_flows(_projects(b), ["region", "project"])


@query("r02_npv", _FLOWS + """,
d as (select unnest([3.0::double, 6.0::double, 10.0::double]) as discount_rate)
select region, project, discount_rate, round(sum(cash_flow / pow(1 + discount_rate / 100, year)), 4) as npv_kusd,
       sum(cash_flow / pow(1 + discount_rate / 100, year)) > 0 as attractive from f, d group by 1, 2, 3""", digits={"npv_kusd": 4})
def r02_npv(b: Bound):
    rates = literal_dim(b.spark, [(3.0,), (6.0,), (10.0,)], "discount_rate DOUBLE")
    return R.npv(R.cash_flows(_projects(b), ["region", "project"]), ["region", "project"], rates)


@query("r03_payback_grid", "with " + _pue_sql("region", "cast(count(distinct date) as double)", 1000) + """,
i as (select unnest(range(0, 20)) as i), j as (select unnest(range(0, 20)) as j),
grid as (select region, project, energy_saved_mwh, 40 + i * (80::double / 19) as energy_price, 0.5::double + j * (1.5::double / 19) as capital_musd
      from roi, i, j where project = 'best practice')
select region, round(energy_price, 6) as energy_price, round(capital_musd, 6) as capital_musd,
       round(case when energy_saved_mwh * energy_price / 1000 > 0 then capital_musd * 1000 / (energy_saved_mwh * energy_price / 1000) else 999 end, 6) as payback_years
from grid""", digits={"energy_price": 6, "capital_musd": 6, "payback_years": 6})
def r03(b: Bound):
    savings = _projects(b).filter("project = 'best practice'").select("region", "energy_saved_mwh")
    grid = R.payback_grid(savings, *R.default_price_grid(b.spark))
    return grid.select("region", "energy_price", "capital_musd", "payback_years")


def contracts(b: Bound) -> DataFrame:
    return literal_dim(
        b.spark,
        [("default", None, 45.0, 70.0, 50.0), ("full", 100.0, 45.0, 70.0, 50.0), ("dear", 100.0, 90.0, 70.0, 50.0)],
        "contract STRING, target_renewable_pct DOUBLE, ppa_price DOUBLE, grid_price DOUBLE, carbon_price DOUBLE",
    )


def _ppa_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""{BASE},
k as (select * from (values ('default', null, 45.0::double, 70.0::double, 50.0::double), ('full', 100.0::double, 45.0::double, 70.0::double, 50.0::double),
      ('dear', 100.0::double, 90.0::double, 70.0::double, 50.0::double)) t(contract, target, ppa_price, grid_price, carbon_price)),
o as (select {keys}cast(sum(electricity_mwh) as double) / cast(count(distinct date) as double) as monthly_mwh,
             cast(sum(renewable_electricity_mwh) as double) / nullif(cast(sum(electricity_mwh) as double), 0) * 100 as renewable_pct,
             cast(sum(scope2_market_tonnes) as double) / count(distinct date) as monthly_scope2_t from base {group}),
t as (select *, coalesce(target::double, case when renewable_pct >= 99 then 100.0::double
                  else least(100.0::double, floor(renewable_pct) + 20) end) as target_renewable_pct from o, k),
e as (select *, (target_renewable_pct - renewable_pct) / 100 * monthly_mwh as extra_mwh from t),
c as (select *, extra_mwh * ppa_price / 1000 as ppa_cost, extra_mwh * grid_price / 1000 as grid_cost, extra_mwh * 0.35::double as carbon_avoided_t from e),
v as (select *, carbon_avoided_t * carbon_price / 1000 as carbon_value from c),
roi as (select {keys}monthly_mwh, renewable_pct, monthly_scope2_t, contract, target_renewable_pct, ppa_price, grid_price, carbon_price, extra_mwh,
               ppa_cost, grid_cost, carbon_avoided_t, carbon_value, ppa_cost - grid_cost - carbon_value as net_cost,
               case when carbon_avoided_t > 0 then (ppa_cost - grid_cost) / carbon_avoided_t * 1000 else 0.0::double end as cost_per_tonne from v)"""


@query("r04_ppa_roi_by_region", "with " + _ppa_sql("region") + " select * from roi")
def r04(b: Bound):
    return R.ppa_roi(base(b), contracts(b), ["region"])


@query("r05_carbon_price_sweep", "with " + _ppa_sql("") + """,
p as (select unnest([0.0::double, 25, 50, 75, 100, 150, 200]) as sweep_price)
select contract, sweep_price, (ppa_cost - grid_cost) - carbon_avoided_t * sweep_price / 1000 as net_cost,
       case when ppa_price > grid_price then (ppa_cost - grid_cost) * 1000 / nullif(carbon_avoided_t, 0) end as break_even_price from roi, p""")
def r05(b: Bound):
    prices = literal_dim(b.spark, [(p,) for p in L.SWEEP_PRICES], "sweep_price DOUBLE")
    return R.carbon_price_sweep(R.ppa_roi(base(b), contracts(b)), prices, ["contract"])


@query("r06_cost_waterfall", "with " + _ppa_sql("") + """
select contract, 'Renewable Energy Cost' as component, ppa_cost as amount from roi union all select contract, 'Grid Cost Avoided', -grid_cost from roi
union all select contract, 'Carbon Value', -carbon_value from roi union all select contract, 'Net Position', net_cost from roi""")
def r06(b: Bound):
    return R.cost_waterfall(R.ppa_roi(base(b), contracts(b)), ["contract"])


@query("r07_water_roi_by_region", f"""
with {BASE},
k as (select * from (values ('recycling', 30.0::double, 0.5::double, 8.5::double), ('closed loop', 45.0::double, 2.0::double, 12.0::double)) t(plan, reduction_pct, capital_musd, water_price)),
o as (select region, cast(sum(water_consumption_gallons) as double) / cast(count(distinct date) as double) as monthly_water,
             cast(sum(water_cost_usd) as double) / cast(count(distinct date) as double) as monthly_water_cost from base where facility_type = 'Data Center' group by 1),
s as (select *, monthly_water * reduction_pct / 100 as water_saved from o, k),
d as (select *, water_saved / 1000 * water_price / 1000 as direct_kusd, water_saved * 0.3::double / 1000 / 1000 * 70 / 1000 as energy_kusd from s)
select region, plan, reduction_pct, capital_musd, water_price, monthly_water, monthly_water_cost, water_saved, direct_kusd, energy_kusd,
       direct_kusd + energy_kusd as monthly_savings_kusd, (direct_kusd + energy_kusd) * 12 as annual_savings_kusd,
       case when (direct_kusd + energy_kusd) * 12 > 0 then capital_musd * 1000 / ((direct_kusd + energy_kusd) * 12) else 999 end as payback_years,
       monthly_water_cost * 1000 / (monthly_water / 1000) as cost_per_kgal from d""")
def r07(b: Bound):
    plans = literal_dim(
        b.spark, [("recycling", 30.0, 0.5, 8.5), ("closed loop", 45.0, 2.0, 12.0)],
        "plan STRING, reduction_pct DOUBLE, capital_musd DOUBLE, water_price DOUBLE",
    )
    return R.water_roi(base(b), plans, ["region"])


_CARBON = f"""with {BASE},
m as (select region, date, sum(scope1_tonnes) as s1, sum(scope2_market_tonnes) as s2 from base group by 1, 2),
a as (select region, {mean_sql('s1')} as s1, {mean_sql('s2')} as s2 from m group by 1),
p as (select * from (values ('Low', 25.0::double), ('Medium', 50.0::double), ('High', 100.0::double)) t(scenario, price)),
c as (select region, scenario, (s1 + s2) * price / 1000 as monthly_cost_kusd, (s1 + s2) * price / 1000 * 12 / 1000 as annual_cost_musd from a, p)"""


def _carbon_prices(b: Bound) -> DataFrame:
    return literal_dim(b.spark, L.CARBON_SCENARIOS, "scenario STRING, price DOUBLE")


@query("r08_carbon_cost_by_region", _CARBON + " select * from c")
def r08(b: Bound):
    return R.carbon_cost_by_region(base(b), _carbon_prices(b))


@query("r08_carbon_cost_totals", _CARBON + " select scenario, round(sum(annual_cost_musd), 6) as annual_cost_musd from c group by 1",
       digits={"annual_cost_musd": 6})
def r08_totals(b: Bound):
    return R.carbon_cost_totals(R.carbon_cost_by_region(base(b), _carbon_prices(b)))


def regional_initiatives(b: Bound) -> DataFrame:
    """The initiative list in every region, its tonnes scaled by the region's share of emissions."""
    per_site = b.meters(facility=True, unit=None).groupBy("facility_id").agg(
        F.sum(F.col("scope1_tonnes") + F.col("scope2_market_tonnes")).alias("t")
    )
    by_region = enrich(per_site, b.facilities().select("facility_id", "region"), "facility_id").groupBy("region").agg(F.sum("t").alias("t"))
    shares = share_of_total(by_region, "t").select("region", "share_pct")
    crossed = shares.crossJoin(F.broadcast(b.initiatives()))
    return crossed.select(
        "region", "initiative", "cost_per_t",
        F.round(F.col("reduction_kt") * F.col("share_pct") / 100, 6).alias("reduction_kt"),
        "capital_musd", "timeframe",
    )


def site_initiatives(b: Bound) -> DataFrame:
    """The initiative list at every facility; tonnes follow the facility's total."""
    per_site = b.meters(facility=True, unit=None).groupBy("facility_id").agg(
        F.round(F.sum(F.col("scope1_tonnes") + F.col("scope2_market_tonnes")) / 1_000_000, 2).cast("double").alias("mt")
    )
    return per_site.crossJoin(F.broadcast(b.initiatives())).select(
        "facility_id", "initiative", "cost_per_t", (F.col("reduction_kt") * F.col("mt")).alias("reduction_kt"),
        "capital_musd", "timeframe",
    )


_REGIONAL = """
st as (select region, sum(scope1_tonnes + scope2_market_tonnes) as t from emissions e join facilities f on e.facility_id = f.facility_id group by 1),
sh as (select region, cast(t as double) * 100 / cast((select sum(t) from st) as double) as share from st),
ri as (select region, initiative, cast(cost_per_t as double) as cost_per_t, cast(capital_musd as double) as capital_musd, timeframe,
              round(reduction_kt * share / 100, 6) as reduction_kt from sh, initiatives)"""


@query("r09_abatement_curve", "with " + _REGIONAL + """
select *, round(sum(reduction_kt) over (partition by region order by cost_per_t, initiative rows unbounded preceding), 6) as cumulative_kt,
       case when cost_per_t < 0 then 'saving' when cost_per_t < 50 then 'low' else 'high' end as cost_band from ri""", digits={"cumulative_kt": 6})
def r09(b: Bound):
    return R.macc(regional_initiatives(b), ["region"])


_SITE_ITEMS = """
si as (select facility_id, cast(round(sum(scope1_tonnes + scope2_market_tonnes) * 0.000001, 2) as double) as mt from emissions group by 1),
items as (select facility_id, initiative, cast(cost_per_t as double) as cost_per_t, reduction_kt * mt as reduction_kt, capital_musd, timeframe,
                 case when facility_id % 3 = 0 then 100 when facility_id % 3 = 1 then 40 else 20 end as budget from si, initiatives),
ranked as (select *, row_number() over (partition by facility_id order by cost_per_t, initiative) as n from items
           where capital_musd <= budget and cost_per_t <= 100),
walk as (select facility_id, initiative, cost_per_t, reduction_kt, capital_musd, timeframe, n, budget, budget - capital_musd as remaining, true as taken
         from ranked where n = 1
         union all
         select r.facility_id, r.initiative, r.cost_per_t, r.reduction_kt, r.capital_musd, r.timeframe, r.n, r.budget,
                case when r.capital_musd <= w.remaining then w.remaining - r.capital_musd else w.remaining end, r.capital_musd <= w.remaining
         from walk w join ranked r on r.facility_id = w.facility_id and r.n = w.n + 1),
sel as (select * from walk where taken)"""


def site_portfolio(b: Bound) -> DataFrame:
    """Budget by facility: 100, 40 or 20."""
    candidates = site_initiatives(b)
    slot = F.col("facility_id") % 3
    portfolios = candidates.select("facility_id").distinct().select(
        "facility_id", F.when(slot == 0, 100.0).when(slot == 1, 40.0).otherwise(20.0).alias("budget_musd"),
        F.lit(100.0).alias("max_cost_per_t"),
    )
    return R.select_portfolio(candidates, portfolios, ["facility_id"])


@query("r10_site_portfolios", "with recursive " + _SITE_ITEMS + """
select facility_id, initiative, cost_per_t, reduction_kt, cast(capital_musd as double) as capital_musd, timeframe from sel""")
def r10(b: Bound):
    return site_portfolio(b)


@query("r10_portfolio_summary", "with recursive " + _SITE_ITEMS + """
select facility_id, count(*) as initiatives, round(sum(reduction_kt), 6) as reduction_kt, cast(sum(capital_musd) as double) as capital_musd,
       round(sum(cost_per_t * reduction_kt) / nullif(sum(reduction_kt), 0), 6) as avg_cost_per_t from sel group by 1""",
       digits={"reduction_kt": 6, "avg_cost_per_t": 6})
def r10_summary(b: Bound):
    return R.portfolio_summary(site_portfolio(b), ["facility_id"])


_DURATION = """
dur as (select * from (values ('Immediate', 0.5::double), ('1 year', 1::double), ('1-2 years', 1.5::double), ('2 years', 2::double), ('2-3 years', 2.5::double),
        ('3-4 years', 3.5::double)) t(timeframe, duration)),
tl as (select sel.*, coalesce(duration, 2::double) as duration from sel left join dur on sel.timeframe = dur.timeframe)"""


@query("r11_implementation_timeline", "with recursive " + _SITE_ITEMS + "," + _DURATION + """
select facility_id, initiative, reduction_kt, duration from tl""")
def r11(b: Bound):
    return R.timeline(site_portfolio(b)).select("facility_id", "initiative", "reduction_kt", "duration")


@query("r12_abatement_by_year", "with recursive " + _SITE_ITEMS + "," + _DURATION + """,
y as (select unnest(range(0, 6)) as year), f as (select distinct facility_id from sel)
select f.facility_id, y.year, round(coalesce(sum(reduction_kt), 0), 6) as reduction_kt
from f cross join y left join tl on tl.facility_id = f.facility_id and floor(duration) <= y.year group by 1, 2""", digits={"reduction_kt": 6})
def r12(b: Bound):
    return R.abatement_timeline(site_portfolio(b), ["facility_id"])


def _history_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""with {BASE},
yr as (select {keys}year(date) as year, {mean_sql('pue')} as pue, {mean_sql('cfe_pct')} as cfe, cast(sum(water_consumption_gallons) as double) as w,
              cast(sum(electricity_mwh) as double) as e, cast(sum(total_emissions) as double) as t from base
       where year(date) between {FIRST_YEAR} and {LAST_FULL_YEAR} group by {keys}year(date)),
h as (select {keys}min(year) as y0, max(year) as y1, arg_min(pue, year) as p0, arg_max(pue, year) as p1, arg_min(cfe, year) as c0, arg_max(cfe, year) as c1,
             arg_min(w, year) as w0, arg_max(w, year) as w1, arg_min(e, year) as e0, arg_max(e, year) as e1, arg_min(t, year) as t0, arg_max(t, year) as t1
      from yr {group} having count(*) >= 2),
n as (select {keys}count(distinct facility_id) as n_sites from base where facility_type = 'Data Center' {group})"""


@query("r13_historical_trend", _history_sql("region") + """
select region, cast(y0 as bigint) as first_year, cast(y1 as bigint) as last_year, cast(y1 - y0 as bigint) as years_span, p0 as first_pue, p1 as last_pue,
       p0 - p1 as pue_change, case when abs(p0 - p1) > 0.005 then 'changed' else 'stable' end as pue_status, c1 - c0 as cfe_change,
       w1 - w0 as water_change, (w1 - w0) / w0 * 100 as water_change_pct, (e1 - e0) / e0 * 100 as electricity_change_pct from h""")
def r13(b: Bound):
    return R.historical_trend(base(b), FIRST_YEAR, LAST_FULL_YEAR, ["region"])


_ROI = """,
g as (select h.*, n_sites, p0 - p1 as pc, c1 - c0 as cc from h join n on {on}),
s as (select *, case when pc > 0.01::double then e1 * (pc / p0) end as saved, case when pc > 0.01::double then pc * 400 * n_sites end as inv,
             case when cc > 0.05::double then e1 * 0.35::double * cc end as avoided, case when cc > 0.05::double then 100.0::double end as contract from g),
v as (select *, saved * 70 / 1000 as sav, avoided * 50 / 1000 as cv from s),
z as (select *, coalesce(inv, 0) + coalesce(contract, 0) as ti, coalesce(sav, 0) + coalesce(cv, 0) as tr from v)
select {keys}cast(y0 as bigint) as first_year, cast(y1 as bigint) as last_year, n_sites, pc as pue_change, cc as cfe_change, w1 - w0 < 0 as water_reduced,
       saved as energy_saved_mwh, sav as energy_savings_kusd, inv as pue_investment_kusd, inv / nullif(sav, 0) as pue_payback_years,
       sav / nullif(inv, 0) * 100 as pue_roi_pct, avoided as carbon_avoided_t, cv as carbon_value_kusd, avoided * 85 / 1000 as carbon_value_eu_kusd,
       ti as total_investment_kusd, tr as total_returns_kusd, case when tr > 0 then ti / tr end as payback_years from z"""


@query("r14_historical_roi_by_facility", _history_sql("facility_id") + _ROI.format(on="h.facility_id = n.facility_id", keys="facility_id, "))
def r14(b: Bound):
    return R.historical_roi(base(b), FIRST_YEAR, LAST_FULL_YEAR, ["facility_id"])


@query("r14_historical_roi_fleet", _history_sql("") + _ROI.format(on="true", keys=""))
def r14_fleet(b: Bound):
    return R.historical_roi(base(b), FIRST_YEAR, LAST_FULL_YEAR)


@query("r15_intensity_change", _history_sql("region") + """,
i as (select region, t0 / e0 * 1000 as a, t1 / e1 * 1000 as b from h)
select region, a as first_intensity, b as last_intensity, (a - b) / a * 100 as improvement_pct,
       case when (a - b) / a * 100 > 0 then 'improved' else 'maintained' end as status from i""")
def r15(b: Bound):
    return R.intensity_change(base(b), FIRST_YEAR, LAST_FULL_YEAR, ["region"])


@query("r16_remaining_opportunity", _history_sql("region") + """,
o as (select h.region, p1, c1, e1, n_sites, greatest(p1 - 1.08::double, 0) as pg, greatest(0.8::double - c1, 0) as cg from h join n on h.region = n.region)
select region, p1 as last_pue, pg as pue_gap, e1 * (pg / p1) as energy_mwh, e1 * (pg / p1) * 70 / 1000 as energy_kusd, pg * 400 * n_sites as investment_kusd,
       c1 as last_cfe_pct, cg as cfe_gap, e1 * 0.35::double * cg as carbon_t, e1 * 0.35::double * cg * 50 / 1000 as carbon_kusd from o""")
def r16(b: Bound):
    return R.remaining_opportunity(base(b), FIRST_YEAR, LAST_FULL_YEAR, by=["region"])


@query("r17_efficiency_impact", f"""
with y as (select year(date) as year, {mean_sql('pue')} as pue, {mean_sql('cfe_pct')} as cfe, cast(sum(electricity_mwh) as double) as mwh
           from combined where year(date) <= {LAST_FULL_YEAR} group by 1),
e as (select min(year) as y0, max(year) as y1, arg_min(pue, year) as p0, arg_max(pue, year) as p1, arg_min(cfe, year) as c0, arg_max(cfe, year) as c1,
             arg_max(mwh, year) as mwh from y),
s as (select *, case when p0 - p1 > 0 then mwh * ((p0 - p1) / p0) end as saved, case when c1 - c0 > 0 then mwh * 0.35::double * (c1 - c0) end as avoided from e)
select cast(y0 as bigint) as first_year, cast(y1 as bigint) as last_year, p0 - p1 as pue_improvement, saved as energy_saved_mwh,
       saved * 70 / 1000 as annual_savings_kusd, saved / 12 * 70 / 1000 as monthly_savings_kusd, saved * 0.35::double as pue_avoided_t, c1 - c0 as cfe_improvement,
       avoided as cfe_avoided_t, avoided * 50 / 1000 as carbon_value_kusd, avoided * 85 / 1000 as eu_value_kusd from s""")
def r17(b: Bound):
    return R.efficiency_impact(b.combined(), LAST_FULL_YEAR)
