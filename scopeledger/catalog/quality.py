"""Validation as registered queries.

The bound tables are clean, so the readings get known defects by formula on
their keys: both engines see the same bad rows, spread over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.catalog.registry import query
from scopeledger.catalog.reports import _AUDIT as AUDIT
from scopeledger.model.lookups import TARGET_CUTS, TYPE_SHARES
from scopeledger.operators.joins import literal_dim, orphans
from scopeledger.plans import allocation as G
from scopeledger.plans import quality as Q
from scopeledger.plans.reports import q07_audit
from scopeledger.sources.binding import AS_OF, YEAR, Bound

#: Months since year 0 and facility decide the defect of a row.
DIRTY = """
dirty as (select case when k % 97 = 5 then null when k % 89 = 3 then facility_id + 1000000000 else facility_id end as facility_id,
       case when k % 101 = 7 then date + interval 20 year else date end as date,
       case when k % 53 = 2 then -scope1_tonnes when k % 59 = 4 then null else scope1_tonnes end as scope1_tonnes,
       scope2_location_tonnes, case when k % 61 = 6 then scope2_location_tonnes + 1 else scope2_market_tonnes end as scope2_market_tonnes,
       scope3_tonnes, electricity_mwh, case when k % 67 = 8 then renewable_pct + 101 else renewable_pct end as renewable_pct, copies, k
  from (select *, year(date) * 12 + month(date) + facility_id * 7 as k,
               case when (year(date) * 12 + month(date) + facility_id * 7) % 71 = 9 then 3 else 1 end as copies from emissions)),
defects as (select facility_id, cast(date as date) as date, scope1_tonnes, scope2_location_tonnes, scope2_market_tonnes, scope3_tonnes, electricity_mwh, renewable_pct
            from dirty, (select unnest(range(1, 4)) as c) where c <= copies)"""


def dirty(b: Bound) -> DataFrame:
    k = F.year("date") * 12 + F.month("date") + F.col("facility_id") * 7
    df = b.emissions().withColumn("k", k)

    def hit(modulus: int, rest: int):
        return F.col("k") % modulus == rest

    copies = F.when(hit(71, 9), 3).otherwise(1)
    return df.select(
        F.when(hit(97, 5), None).when(hit(89, 3), F.col("facility_id") + 1_000_000_000).otherwise(F.col("facility_id")).alias("facility_id"),
        F.when(hit(101, 7), F.add_months("date", 240)).otherwise(F.col("date")).alias("date"),
        F.when(hit(53, 2), -F.col("scope1_tonnes")).when(hit(59, 4), None).otherwise(F.col("scope1_tonnes")).alias("scope1_tonnes"),
        "scope2_location_tonnes",
        F.when(hit(61, 6), F.col("scope2_location_tonnes") + 1).otherwise(F.col("scope2_market_tonnes")).alias("scope2_market_tonnes"),
        "scope3_tonnes", "electricity_mwh",
        F.when(hit(67, 8), F.col("renewable_pct") + 101).otherwise(F.col("renewable_pct")).alias("renewable_pct"),
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


_RULES = {
    **{f"not_null:{c}": f"{c} is null" for c in ["facility_id", "date", *Q.SCOPE_COLUMNS]},
    **{f"non_negative:{c}": f"{c} < 0" for c in [*Q.SCOPE_COLUMNS, "electricity_mwh"]},
    "range:renewable_pct": "not (renewable_pct between 0 and 100)",
    "market_not_above_location": "scope2_market_tonnes > scope2_location_tonnes",
    "date_not_in_future": f"date > date '{AS_OF}'",
}

_SUMMARY = "with " + DIRTY + """,
n as (select count(*) as n from defects),
r as (""" + " union all ".join(
    f"select '{rule}' as rule, count(*) filter (where {bad}) as failed from defects" for rule, bad in _RULES.items()
) + """)
select rule, 'error' as severity, failed, round((n - failed) * 100.0::double / n, 2) as pass_rate_pct from r, n"""


@query("d01_row_rules", _SUMMARY)
def d01(b: Bound):
    return Q.row_summary(dirty(b), Q.emission_rules(AS_OF))


_FAILED = "with " + DIRTY + """,
rep as (select facility_id, date from defects where facility_id is not null and date is not null group by 1, 2 having count(*) > 1),
m as (select d.*, r.facility_id is not null as is_rep, d.facility_id is not null and f.facility_id is null as is_lost
      from defects d left join rep r on d.facility_id = r.facility_id and d.date = r.date left join facilities f on d.facility_id = f.facility_id),
fl as (""" + " union all ".join(f"select '{rule}' as rule, count(*) as failed from m where {bad}" for rule, bad in _RULES.items()) + """
  union all select 'unique:facility_id,date', count(*) from m where is_rep union all select 'reference:facility_id', count(*) from m where is_lost)"""


def _split(b: Bound):
    return Q.validate(dirty(b), Q.emission_rules(AS_OF), ["facility_id", "date"], {"facility_id": b.facilities()})


@query("d02_failed_rule_summary", _FAILED + """
select rule, failed, (select count(*) from defects) as total_rows,
       round(((select count(*) from defects) - failed) * 100.0::double / (select count(*) from defects), 2) as pass_rate_pct
from fl where failed > 0""")
def d02(b: Bound):
    return _split(b)[2]


_GOOD = " and ".join(f"not coalesce({bad}, false)" for bad in _RULES.values())


@query("d03_clean_rows", _FAILED + f"""
select facility_id, date, cast(scope1_tonnes as double) as scope1_tonnes, cast(scope2_market_tonnes as double) as scope2_market_tonnes
from m where not is_rep and not is_lost and {_GOOD}""")
def d03(b: Bound):
    return _split(b)[0].select("facility_id", "date", "scope1_tonnes", "scope2_market_tonnes")


@query("d04_quarantined_by_year", _FAILED + f"""
select cast(year(date) as bigint) as year, count(*) as quarantined from m where is_rep or is_lost or not ({_GOOD}) group by 1""")
def d04(b: Bound):
    return _split(b)[1].groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("quarantined"))


@query("d05_enumerations", """
with r as (select 'allowed:facility_type' as rule, count(*) filter (where facility_type not in ('Data Center', 'Office', 'Manufacturing')) as failed from facilities
  union all select 'not_null:facility_id', count(*) filter (where facility_id is null) from facilities
  union all select 'not_null:facility_name', count(*) filter (where facility_name is null) from facilities
  union all select 'not_null:region', count(*) filter (where region is null) from facilities
  union all select 'not_null:facility_type', count(*) filter (where facility_type is null) from facilities)
select rule, 'error' as severity, failed, round(((select count(*) from facilities) - failed) * 100.0::double / (select count(*) from facilities), 2) as pass_rate_pct from r""")
def d05(b: Bound):
    return Q.row_summary(b.facilities(), Q.facility_rules())


def _rules_sql(relation: str, rules: dict[str, str], lead: str = "") -> str:
    """Failures and pass rate of every rule over a relation with defects."""
    counts = " union all ".join(f"select '{rule}' as rule, count(*) filter (where {bad}) as failed from {relation}" for rule, bad in rules.items())
    return f"with {lead}n as (select count(*) as n from {relation}), r as ({counts}) " \
        "select rule, 'error' as severity, failed, round((n - failed) * 100.0::double / n, 2) as pass_rate_pct from r, n"


@query("d04_quality_flags", _rules_sql(
    "flagged", _RULES | {"allowed:data_quality_flag": "flag not in ('Verified', 'Estimated', 'Flagged')"},
    DIRTY.strip() + """, flagged as (select *, case when month(date) % 12 = 5 then 'Unchecked' when month(date) % 3 = 0 then 'Verified'
    when month(date) % 3 = 1 then 'Estimated' when year(date) % 2 = 0 then 'Flagged' end as flag from defects), """))
def d04_flags(b: Bound):
    month = F.month("date")
    flag = F.when(month == 5, "Unchecked").when(month % 3 == 0, "Verified").when(month % 3 == 1, "Estimated").when(F.year("date") % 2 == 0, "Flagged")
    return Q.row_summary(dirty(b).withColumn("data_quality_flag", flag), Q.emission_rules(AS_OF, flagged=True))


@query("d04_site_enumerations", _rules_sql("claimed", {
    "not_null:facility_id": "facility_id is null", "not_null:facility_name": "name is null", "not_null:region": "place is null",
    "not_null:facility_type": "kind is null", "allowed:facility_type": "kind not in ('Data Center', 'Office', 'Manufacturing')",
    "range:typical_renewable_pct": "share not between 0 and 100", "allowed:relative_size": "size not in ('Small', 'Medium', 'Large')",
}, """claimed as (select facility_id, case when facility_id % 17 <> 2 then facility_name end as name, case when facility_id % 19 <> 3 then region end as place,
    case when facility_id % 13 = 4 then 'Warehouse' when facility_id % 11 <> 5 then facility_type end as kind, facility_id * 7 % 120 - 5 as share,
    case facility_id % 5 when 0 then 'Small' when 1 then 'Medium' when 2 then 'Large' when 3 then 'Huge' end as size from facilities), """))
def d04_sites(b: Bound):
    at = F.col("facility_id")
    size = F.when(at % 5 == 0, "Small").when(at % 5 == 1, "Medium").when(at % 5 == 2, "Large").when(at % 5 == 3, "Huge")
    claimed = b.facilities().select(
        "facility_id", F.when(at % 17 != 2, F.col("facility_name")).alias("facility_name"), F.when(at % 19 != 3, F.col("region")).alias("region"),
        F.when(at % 13 == 4, "Warehouse").when(at % 11 != 5, F.col("facility_type")).alias("facility_type"),
        (at * 7 % 120 - 5).alias("typical_renewable_pct"), size.alias("relative_size"),
    )
    return Q.row_summary(claimed, Q.facility_rules(full=True))


@query("d04_factor_scopes", _rules_sql("factors", {
    "allowed:scope": "scope not in ('Scope 1', 'Scope 2', 'Scope 3')", "non_negative:emission_factor": "factor < 0",
}, "factors as (select 'Scope ' || (p_size % 4 + 1) as scope, p_retailprice - 1000 as factor from part), "))
def d04_factors(b: Bound):
    scope = F.concat(F.lit("Scope "), (F.col("p_size") % 4 + 1).cast("string"))
    return Q.row_summary(b.read("part").select(scope.alias("scope"), (F.col("p_retailprice") - 1000).alias("emission_factor")), Q.factor_rules())


@query("d06_business_defects", _rules_sql("wrong", {
    "not_null:facility_id": "facility_id is null", "not_null:date": "date is null", "non_negative:revenue_millions": "revenue < 0",
    "non_negative:headcount": "people < 0", "non_negative:square_feet": "space < 0", "non_negative:server_count": "servers < 0",
}, """wrong as (select case when k % 43 <> 1 then facility_id end as facility_id, case when k % 47 <> 2 then date end as date,
    case when k % 37 = 3 then -revenue_millions else revenue_millions end as revenue, case when k % 41 = 4 then -headcount else headcount end as people,
    case when k % 31 = 5 then null when k % 29 = 6 then -square_feet else square_feet end as space, case when k % 23 = 7 then -server_count else server_count end as servers
    from (select *, year(date) * 12 + month(date) + facility_id * 7 as k from business)), """))
def d06_defects(b: Bound):
    def turned(c: str, modulus: int, rest: int):
        return F.when(k % modulus == rest, -F.col(c)).otherwise(F.col(c)).alias(c)

    k = F.year("date") * 12 + F.month("date") + F.col("facility_id") * 7
    wrong = b.business().select(
        F.when(k % 43 != 1, F.col("facility_id")).alias("facility_id"), F.when(k % 47 != 2, F.col("date")).alias("date"),
        turned("revenue_millions", 37, 3), turned("headcount", 41, 4),
        F.when(k % 31 == 5, None).when(k % 29 == 6, -F.col("square_feet")).otherwise(F.col("square_feet")).alias("square_feet"), turned("server_count", 23, 7),
    )
    return Q.row_summary(wrong, Q.business_rules())


@query("d10_target_defects", _rules_sql("aims", {
    "non_negative:baseline_emissions": "base < 0", "non_negative:target_emissions": "aim < 0", "target_after_baseline": "target_year <= baseline_year",
}, """aims as (select year(date) as baseline_year, year(date) + facility_id % 4 - 1 as target_year, sum(scope1_tonnes) - 900 as base, sum(scope1_tonnes) - 1100 as aim
    from emissions group by facility_id, year(date)), """))
def d10_defects(b: Bound):
    """A target of every facility and year, cut too deep for small ones and dated too early for some."""
    yearly = b.meters(facility=True, unit="year").select(
        F.year("date").alias("baseline_year"), (F.year("date") + F.col("facility_id") % 4 - 1).alias("target_year"),
        (F.col("scope1_tonnes") - 900).alias("baseline_emissions"), (F.col("scope1_tonnes") - 1100).alias("target_emissions"),
    )
    return Q.row_summary(yearly, Q.target_rules())


@query("q07_quality_audit_of_defects", "with " + DIRTY + AUDIT.replace("with d as", ", d as", 1).replace(" from emissions)", " from defects)").format(
    extra="union all select 'Complete Scope 3', n - m3, n from d"))
def q07_defects(b: Bound):
    return q07_audit(dirty(b), with_scope3=True)


@query("d06_business_rules", """
with n as (select count(*) as n from business),
r as (select 'not_null:facility_id' as rule, count(*) filter (where facility_id is null) as failed from business
  union all select 'not_null:date', count(*) filter (where date is null) from business
  union all select 'non_negative:revenue_millions', count(*) filter (where revenue_millions < 0) from business
  union all select 'non_negative:headcount', count(*) filter (where headcount < 0) from business
  union all select 'non_negative:square_feet', count(*) filter (where square_feet < 0) from business
  union all select 'non_negative:server_count', count(*) filter (where server_count < 0) from business)
select rule, 'error' as severity, failed, round((n - failed) * 100.0::double / n, 2) as pass_rate_pct from r, n""")
def d06(b: Bound):
    return Q.row_summary(b.business(), Q.business_rules())


@query("d07_duplicate_keys", "with " + DIRTY + """
select facility_id, date, count(*) as rows from defects group by 1, 2 having count(*) > 1""")
def d07(b: Bound):
    return Q.duplicate_keys(dirty(b), ["facility_id", "date"])


@query("d07_deduplicated", "with " + DIRTY + """,
r as (select *, row_number() over (partition by facility_id, date order by scope1_tonnes nulls first, scope2_location_tonnes, scope2_market_tonnes, scope3_tonnes,
             electricity_mwh, renewable_pct) as n from defects where facility_id is not null)
select facility_id, date, cast(scope1_tonnes as double) as scope1_tonnes, cast(scope3_tonnes as double) as scope3_tonnes from r where n = 1""")
def d07_dedupe(b: Bound):
    kept = Q.dedupe(dirty(b).filter(F.col("facility_id").isNotNull()), ["facility_id", "date"])
    return kept.select("facility_id", "date", "scope1_tonnes", "scope3_tonnes")


@query("d08_duplicate_primary_keys", """
select o_custkey, count(*) as rows from orders group by 1 having count(*) > 1""")
def d08(b: Bound):
    return Q.duplicate_keys(b.read("orders"), ["o_custkey"])


@query("d09_orphan_facilities", "with " + DIRTY + """
select d.facility_id, count(*) as rows from defects d left join facilities f on d.facility_id = f.facility_id
where f.facility_id is null group by 1""")
def d09(b: Bound):
    return orphans(dirty(b), b.facilities(), "facility_id")


@query("d10_target_rules", """
with n as (select count(*) as n from targets),
r as (select 'non_negative:baseline_emissions' as rule, count(*) filter (where baseline_emissions < 0) as failed from targets
  union all select 'non_negative:target_emissions', count(*) filter (where target_emissions < 0) from targets
  union all select 'target_after_baseline', count(*) filter (where target_year <= baseline_year) from targets)
select rule, 'error' as severity, failed, round((n - failed) * 100.0::double / n, 2) as pass_rate_pct from r, n""")
def d10(b: Bound):
    return Q.row_summary(b.targets(), Q.target_rules())


@query("d11_category_rules", """
with c as (select cast(p_size as integer) as category_id, p_retailprice / 100 as pct, case when p_size % 2 = 0 then 'Upstream' else 'Sideways' end as stream from part),
r as (select 'range:category_id' as rule, count(*) filter (where category_id not between 1 and 15) as failed from c
  union all select 'non_negative:typical_pct_of_scope3', count(*) filter (where pct < 0) from c
  union all select 'allowed:upstream_downstream', count(*) filter (where stream not in ('Upstream', 'Downstream')) from c)
select rule, 'error' as severity, failed, round(((select count(*) from c) - failed) * 100.0::double / (select count(*) from c), 2) as pass_rate_pct from r""")
def d11(b: Bound):
    stream = F.when(F.col("p_size") % 2 == 0, "Upstream").otherwise("Sideways")
    claimed = b.read("part").select(
        F.col("p_size").alias("category_id"), (F.col("p_retailprice") / 100).alias("typical_pct_of_scope3"),
        stream.alias("upstream_downstream"),
    )
    return Q.row_summary(claimed, Q.category_rules())


@query("d12_completeness_by_facility", """
select facility_id, count(distinct date) as present, cast(datediff('month', min(date), max(date)) + 1 as bigint) as expected,
       cast(datediff('month', min(date), max(date)) + 1 - count(distinct date) as bigint) as missing from emissions group by 1""")
def d12(b: Bound):
    return Q.completeness(b.emissions(), "date", ["facility_id"])


@query("d13_missing_months", """
with r as (select facility_id, min(date) as lo, max(date) as hi from emissions group by 1),
s as (select facility_id, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as date from r)
select s.facility_id, s.date from s left join emissions e on e.facility_id = s.facility_id and e.date = s.date where e.date is null""")
def d13(b: Bound):
    return Q.missing_months(b.emissions(), "date", ["facility_id"])


# -- allocation -----------------------------------------------------------------

_ANNUAL = """
annual as (select year(date) as year, cast(sum(scope1_tonnes) as double) as scope1, cast(sum(scope2_market_tonnes) as double) as scope2_market,
                  cast(sum(scope3_tonnes) as double) as scope3 from emissions group by 1)"""


def annual(b: Bound) -> DataFrame:
    return b.meters(unit="year").groupBy(F.year("date").alias("year")).agg(
        F.sum("scope1_tonnes").cast("double").alias("scope1"),
        F.sum("scope2_market_tonnes").cast("double").alias("scope2_market"),
        F.sum("scope3_tonnes").cast("double").alias("scope3"),
    )


SPREAD = ["scope1", "scope2_market", "scope3"]

_INTERPOLATED = "with " + _ANNUAL + """,
nx as (select a.year, a.scope1, a.scope2_market, a.scope3, coalesce(n.scope1, a.scope1) as n1, coalesce(n.scope2_market, a.scope2_market) as n2,
              coalesce(n.scope3, a.scope3) as n3 from annual a left join annual n on n.year = a.year + 1),
ms as (select distinct date, (month(date) - 1) / 11.0::double as t, case when month(date) in (6, 7, 8) then 1.03::double when month(date) in (12, 1, 2) then 1.02::double else 1.0::double end as f from emissions),
mo as (select date, f, (scope1 + (n1 - scope1) * t) / 12 as scope1, (scope2_market + (n2 - scope2_market) * t) / 12 as scope2_market,
              (scope3 + (n3 - scope3) * t) / 12 as scope3 from ms join nx on nx.year = year(date))"""


def _months(b: Bound) -> DataFrame:
    return G.interpolate_annual(annual(b), b.emissions().select("date").distinct(), SPREAD)


@query("g02_monthly_interpolation", _INTERPOLATED + """
select date, cast(year(date) as bigint) as year, scope1, scope2_market, scope3 from mo""")
def g02(b: Bound):
    return _months(b)


@query("g03_seasonal_factors", _INTERPOLATED + """
select date, cast(year(date) as bigint) as year, scope1, scope2_market * f as scope2_market, scope3 from mo""")
def g03(b: Bound):
    return G.seasonal(_months(b))


def _allocated(b: Bound, noise: float) -> DataFrame:
    shares = literal_dim(b.spark, TYPE_SHARES, "facility_type STRING, share DOUBLE")
    return G.allocate(G.seasonal(_months(b)), b.facilities(), shares, SPREAD, noise)


@query("g04_facility_allocation", _INTERPOLATED + """,
ty as (select facility_type, count(*) as n from facilities group by 1),
al as (select f.facility_id, f.region, date, case f.facility_type when 'Data Center' then 0.85::double when 'Office' then 0.10::double else 0.05::double end / n as fr, scope1, scope2_market * m.f as s2, scope3
       from facilities f join ty on ty.facility_type = f.facility_type, mo m)
select facility_id, date, scope1 * fr as scope1, s2 * fr as scope2_market, scope3 * fr as scope3 from al""")
def g04(b: Bound):
    return _allocated(b, 0.0).select("facility_id", "date", *SPREAD)


@query("g05_facility_allocation_varied", _INTERPOLATED + """,
ty as (select facility_type, count(*) as n from facilities group by 1),
al as (select f.facility_id, date, case f.facility_type when 'Data Center' then 0.85::double when 'Office' then 0.10::double else 0.05::double end / n
                * ((1 - 0.05::double) + 0.1::double * (('0x' || substr(md5(f.facility_id || '|' || strftime(date, '%Y-%m-%d')), 1, 8))::bigint / 4294967296.0::double)) as fr,
              scope1, scope2_market * m.f as s2, scope3
       from facilities f join ty on ty.facility_type = f.facility_type, mo m)
select facility_id, date, round(scope1 * fr, 6) as scope1, round(s2 * fr, 6) as scope2_market, round(scope3 * fr, 6) as scope3 from al""",
       digits={"scope1": 6, "scope2_market": 6, "scope3": 6})
def g05(b: Bound):
    return _allocated(b, 0.05).select("facility_id", "date", *SPREAD)


_DIGITS = {c: 6 for c in ("water_consumption_gallons", "water_withdrawal_gallons", "water_discharge_gallons", "waste_diverted_tons", "electricity_mwh", "pue", "cfe_pct")}


@query("g06_derived_operations", _INTERPOLATED + """,
ty as (select facility_type, count(*) as n from facilities group by 1),
yw as (select year, scope1 * 100 as water, (select scope1 * 100 from annual where year = 1997) as base from annual),
al as (select f.facility_id, f.region, f.facility_type, date, year(date) as year, m.f,
              case month(date) when 6 then 1.04::double when 7 then 1.04::double when 8 then 1.04::double when 12 then 0.98::double when 1 then 0.98::double when 2 then 0.98::double
                   else 1.0::double end as wf,
              case f.facility_type when 'Data Center' then 0.85::double when 'Office' then 0.10::double else 0.05::double end / ty.n as share, scope1,
              (1 - 0.05::double) + 0.1::double * (('0x' || substr(md5(f.facility_id || '|' || strftime(date, '%Y-%m-%d')), 1, 8))::bigint / 4294967296.0::double) as v
       from facilities f join ty on ty.facility_type = f.facility_type, mo m),
op as (select al.*, case when al.facility_type = 'Data Center' and al.facility_id % 20 < 3 then al.facility_id * 1000.0::double / 12 * yw.water / yw.base * v
              else scope1 * 100 * wf * (share * v) end as water, coalesce(cast(p.cfe_share as double), 0.65::double) as cfe
       from al join yw on yw.year = al.year left join prices p on p.region = al.region)
select facility_id, date, round(water, 6) as water_consumption_gallons, round(water * 1.35::double, 6) as water_withdrawal_gallons,
       round(water * 1.35::double - water, 6) as water_discharge_gallons, round(scope1 * (share * v) * 0.8::double, 6) as waste_diverted_tons,
       round(scope1 * 10 * f * (share * v), 6) as electricity_mwh,
       case when facility_type = 'Data Center' and facility_id % 20 < 3 then round(1.1::double + (facility_id % 5) / 100.0::double + (year - 1997) * 0.002::double, 6) end as pue,
       round(cfe, 6) as cfe_pct
from op""", digits=_DIGITS)
def g06(b: Bound):
    """Operations derived from yearly totals for every facility and month; some data centres are metered."""
    yearly = annual(b).withColumns({
        "scope2_location": F.col("scope2_market"), "electricity": F.col("scope1") * 10, "fuel": F.col("scope1") * 5, "water": F.col("scope1") * 100,
        "waste": F.col("scope1"), "replenishment_pct": F.lit(0.2), "diversion_pct": F.lit(0.8),
    })
    monthly = G.seasonal(G.interpolate_annual(yearly, b.emissions().select("date").distinct()))
    shares = literal_dim(b.spark, TYPE_SHARES, "facility_type STRING, share DOUBLE")
    records = G.allocate(monthly, b.facilities(), shares)
    at = F.col("facility_id")
    metered = b.facilities().where(at % 20 < 3).select(at, (at * 1000.0).alias("water_2024"), (1.1 + at % 5 / F.lit(100.0)).alias("pue_2024"))
    derived = G.derive_operations(records, metered, b.regional_prices(), yearly, reference_year=YEAR - 1)
    return derived.select("facility_id", "date", *_DIGITS)


@query("g07_regional_costs", """
select facility_id, date, cast(energy_cost_usd as double) as energy_cost_usd, cast(water_cost_usd as double) as water_cost_usd, round(cast(carbon_cost_usd as double), 8) as carbon_cost_usd
from combined""", digits={"carbon_cost_usd": 8})
def g07(b: Bound):
    stored = b.combined().drop("energy_cost_usd", "water_cost_usd", "carbon_cost_usd")
    priced = G.derive_costs(stored, b.regional_prices())
    return priced.select("facility_id", "date", "energy_cost_usd", "water_cost_usd", "carbon_cost_usd")


@query("g08_targets_from_baseline", "with " + _ANNUAL + """
select 'Scope 1 & 2' as scope, cast(1998 as bigint) as baseline_year, scope1 + scope2_market as baseline_emissions, cast(2008 as bigint) as target_year,
       50.0::double as reduction_percent, (scope1 + scope2_market) * (1 - 50.0::double / 100) as target_emissions, true as sbti_aligned from annual where year = 1998
union all select 'Scope 3', 1998, scope3, 2008, 30.0::double, scope3 * (1 - 30.0::double / 100), true from annual where year = 1998""")
def g08(b: Bound):
    return G.make_targets(annual(b), YEAR, TARGET_CUTS)


@query("g09_verify_totals", "with " + _ANNUAL + """,
y as (select year(date) as year, cast(sum(total_emissions) as double) as g from emis group by 1),
p as (select year, scope1 + scope2_market + scope3 + year * 1000 as published from annual)
select cast(y.year as bigint) as year, round(g, 0) as generated, round(published, 4) as published, round(abs((g - published) / published * 100), 8) as diff_pct
from y join p on y.year = p.year""", digits={"published": 4, "diff_pct": 8})
def g09(b: Bound):
    published = annual(b).select(
        "year", (F.col("scope1") + F.col("scope2_market") + F.col("scope3") + F.col("year") * 1000).alias("total")
    )
    return G.verify_totals(b.emissions(), published)

