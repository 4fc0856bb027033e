"""Loaders and joins as registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from scopeledger.catalog.registry import query
from scopeledger.functions.scalars import total_emissions, year_of
from scopeledger.model.lookups import CARBON_SCENARIOS
from scopeledger.model.schemas import OPERATION_COLUMNS
from scopeledger.operators import joins as J
from scopeledger.operators.filters import in_year
from scopeledger.sources import loaders as Ld
from scopeledger.sources.binding import YEAR, Bound

FIRST, LAST = date(YEAR, 1, 1), date(YEAR, 12, 1)

_EMISSION_DOUBLES = ", ".join(f"cast({c} as double) as {c}" for c in Ld.EMISSION_COLUMNS)
_OPERATION_DOUBLES = ", ".join(f"cast({c} as double) as {c}" for c in OPERATION_COLUMNS)



@query("s01_load_emissions", f"""
select f.facility_id, facility_name, region, facility_type, date, {_EMISSION_DOUBLES} from emis e join facilities f on e.facility_id = f.facility_id""")
def s01(b: Bound):
    return Ld.load_emissions(b.spark, b.tables())


@query("s01_load_emissions_filtered", f"""
select f.facility_id, facility_name, region, facility_type, date, {_EMISSION_DOUBLES} from emis e join facilities f on e.facility_id = f.facility_id
where e.facility_id in (1, 2, 3, 5, 8) and date >= '1996-01-01' and date <= '1998-06-30'""")
def s01_filtered(b: Bound):
    return Ld.load_emissions(b.spark, b.tables(), [1, 2, 3, 5, 8], "1996-01-01", "1998-06-30")


@query("s02_load_operational", f"""
select f.facility_id, facility_name, region, facility_type, date, {_OPERATION_DOUBLES} from operations o join facilities f on o.facility_id = f.facility_id""")
def s02(b: Bound):
    return Ld.load_operational(b.spark, b.tables())


@query("s03_load_combined", f"""
select facility_id, facility_name, region, facility_type, date, {_EMISSION_DOUBLES}, {_OPERATION_DOUBLES} from combined""")
def s03(b: Bound):
    return Ld.load_combined(b.spark, b.tables())


@query("s03_combined_single_pass", f"""
select facility_id, facility_name, region, facility_type, date, {_EMISSION_DOUBLES}, {_OPERATION_DOUBLES} from combined""")
def s03_single(b: Bound):
    return b.combined()


@query("s04_load_facilities", "select * from facilities")
def s04(b: Bound):
    return Ld.load_facilities(b.spark, b.tables())


@query("s06_load_targets", "select * from targets")
def s06(b: Bound):
    return Ld.load_targets(b.spark, b.tables())


_JOINED = "cast(sum(total_emissions) as double) as total_emissions, count(*) as rows"


@query("j01_fact_to_dimension", f"""
select facility_type, {_JOINED} from emis e join facilities f on e.facility_id = f.facility_id group by 1""")
def j01(b: Bound):
    fact = b.emissions().select("facility_id", total_emissions().alias("total_emissions"))
    per_site = fact.groupBy("facility_id").agg(F.sum("total_emissions").alias("t"), F.count(F.lit(1)).alias("n"))
    return J.enrich(per_site, b.facilities(), "facility_id").groupBy("facility_type").agg(
        F.sum("t").alias("total_emissions"), F.sum("n").alias("rows")
    )


_PAIRED = """
select e.facility_id, e.date, cast(total_emissions as double) as total_emissions, cast(revenue_millions as double) as revenue_millions
from emis e {how} join business b on e.facility_id = b.facility_id and e.date = b.date"""


def _paired(b: Bound, how: str):
    fact = b.emissions().select("facility_id", "date", total_emissions().alias("total_emissions"))
    return J.enrich(fact, b.business().select("facility_id", "date", "revenue_millions"), ["facility_id", "date"], how)


@query("j02_composite_key_inner", _PAIRED.format(how=""))
def j02(b: Bound):
    return _paired(b, "inner")


@query("j03_composite_key_left", _PAIRED.format(how="left"))
def j03(b: Bound):
    return _paired(b, "left")


@query("j04_aggregate_then_cross", """
select cast(category_id as bigint) as category_id, cast(sum(scope3_tonnes) as double) * (typical_pct_of_scope3 / 100) as estimated_tonnes
from emissions, categories where year(date) = 1998 group by category_id, typical_pct_of_scope3""")
def j04(b: Bound):
    total = in_year(b.meters(FIRST, LAST, unit="year"), YEAR).agg(F.sum("scope3_tonnes").alias("t"))
    split = J.allocate_by_share(total, "t", b.categories(), F.col("typical_pct_of_scope3") / 100, "estimated_tonnes")
    return split.select("category_id", "estimated_tonnes")


@query("j05_cross_one_filtered_row", """
with y as (select year(date) as year, cast(sum(scope1_tonnes + scope2_market_tonnes) as double) as actual from emissions group by 1)
select cast(year as bigint) as year, actual, baseline_emissions from y, (select * from targets where scope = 'Scope 1 & 2')""")
def j05(b: Bound):
    yearly = b.meters(unit="year").groupBy(year_of("date").alias("year")).agg(
        F.sum(F.col("scope1_tonnes") + F.col("scope2_market_tonnes")).alias("actual")
    )
    goal = b.targets().filter(F.col("scope") == "Scope 1 & 2").select("baseline_emissions")
    return J.with_constant_row(yearly, goal)


@query("j06_two_one_row_relations", """
with m as (select date, sum(total_emissions) as v from emis group by 1), r as (select * from m order by date desc limit 1),
p as (select v as prior from m where date = (select date - interval 1 year from r))
select date, cast(v as double) as recent, cast(prior as double) as prior from r, p""")
def j06(b: Bound):
    monthly = b.meters().groupBy("date").agg(F.sum(total_emissions()).alias("recent"))
    recent = monthly.orderBy(F.col("date").desc()).limit(1)
    prior = J.same_period_last_year(monthly, "date", "recent").select("date", F.col("prior_recent").alias("prior"))
    return recent.join(F.broadcast(prior), "date")


@query("j07_same_month_last_year", """
with m as (select facility_id, date, sum(total_emissions) as v from emis group by 1, 2)
select a.facility_id, a.date, cast(a.v as double) as v, cast(p.v as double) as prior_v
from m a join m p on p.facility_id = a.facility_id and p.date = a.date - interval 1 year""")
def j07(b: Bound):
    monthly = b.emissions().groupBy("facility_id", "date").agg(F.sum(total_emissions()).alias("v"))
    return J.same_period_last_year(monthly, "date", "v", ["facility_id"])


@query("j08_enrich_after_aggregate", """
select f.facility_id, facility_name, region, cast(sum(scope1_tonnes) as double) as scope1 from emissions e right join facilities f on e.facility_id = f.facility_id group by 1, 2, 3""")
def j08(b: Bound):
    sums = b.meters(facility=True, unit=None).groupBy("facility_id").agg(F.sum("scope1_tonnes").alias("scope1"))
    return J.enrich(b.facilities().select("facility_id", "facility_name", "region"), sums, "facility_id", "left")


@query("j09_parameter_grid", """
with p as (select * from (values ('Low', 25::double), ('Medium', 50::double), ('High', 100::double)) t(scenario, price)),
r as (select region, cast(sum(scope1_tonnes) as double) as t from emissions e join facilities f on e.facility_id = f.facility_id group by 1),
h as (select unnest(range(0, 5)) as h)
select region, scenario, 10 + h * 5::double as handling, t * (price + 10 + h * 5::double) / 1000 as cost_kusd from r, p, h""")
def j09(b: Bound):
    sums = b.meters(facility=True, unit=None).groupBy("facility_id").agg(F.sum("scope1_tonnes").alias("s"))
    by_region = J.enrich(sums, b.facilities(), "facility_id").groupBy("region").agg(F.sum("s").cast("double").alias("t"))
    prices = J.literal_dim(b.spark, CARBON_SCENARIOS, "scenario STRING, price DOUBLE")
    grid = J.scenario_grid(by_region, prices, J.number_grid(b.spark, "handling", 10.0, 30.0, 5))
    cost = F.col("t") * (F.col("price") + F.col("handling")) / 1000
    return grid.select("region", "scenario", "handling", cost.alias("cost_kusd"))


@query("j10_orphan_keys", """
select o_custkey, count(*) as rows from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0) group by 1""")
def j10(b: Bound):
    known = b.read("customer").filter(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("o_custkey"))
    return J.orphans(b.read("orders"), known, "o_custkey")
