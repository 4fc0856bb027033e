"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopeledger.sources.binding import Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The bound tables in SQL; each may use the ones before it.
VIEWS: dict[str, str] = {
    "facilities": """
        select s_suppkey as facility_id, s_name as facility_name,
               case r_name when 'AMERICA' then 'US-East' when 'AFRICA' then 'US-Central'
                           when 'EUROPE' then 'EU' when 'ASIA' then 'APAC' else r_name end as region,
               case when s_suppkey % 20 < 9 then 'Data Center'
                    when s_suppkey % 20 < 16 then 'Office' else 'Manufacturing' end as facility_type
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "emissions": """
        select l_suppkey as facility_id, cast(date_trunc('month', l_shipdate) as date) as date,
               cast(sum(cast(l_quantity as decimal(12,2))) as decimal(24,4)) as scope1_tonnes,
               cast(sum(cast(l_extendedprice as decimal(14,2))) as decimal(24,4)) as scope2_location_tonnes,
               cast(sum(cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(4,2)))) as decimal(24,4)) as scope2_market_tonnes,
               cast(sum(cast(l_extendedprice as decimal(14,2)) * (1 + cast(l_tax as decimal(4,2)))) as decimal(24,4)) as scope3_tonnes,
               cast(sum(cast(l_quantity as decimal(12,2))) * 10 as decimal(24,4)) as electricity_mwh,
               cast((sum(cast(cast(l_discount as decimal(4,2)) * 100 as bigint)) * 10000000 // count(*)) as decimal(20,0)) * 0.000001 as renewable_pct
        from lineitem group by 1, 2""",
    "emis": """
        select *, cast(scope1_tonnes + scope2_market_tonnes + scope3_tonnes as decimal(26,4)) as total_emissions
        from emissions""",
    "operations_base": """
        select l_suppkey as facility_id, cast(date_trunc('month', l_shipdate) as date) as date,
               sum(cast(l_quantity as bigint)) as qty, count(*) as n,
               sum(cast(cast(l_discount as decimal(4,2)) * 100 as bigint)) as disc,
               sum(cast(cast(l_tax as decimal(4,2)) * 100 as bigint)) as tax,
               sum(case when l_returnflag <> 'R' then cast(l_quantity as bigint) else 0 end) as kept,
               sum(cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(4,2)))) as net
        from lineitem group by 1, 2""",
    "prices": """
        select * from (values ('US-East', 0.68, 65.0, 8.5, 0.0), ('US-West', 0.87, 85.0, 12.0, 25.0),
                              ('US-Central', 0.88, 55.0, 6.5, 0.0), ('EU', 0.83, 120.0, 10.0, 85.0),
                              ('APAC', 0.12, 95.0, 7.0, 5.0)) t(region, cfe_share, energy_price, water_price, carbon_price)""",
    "operations": """
        select o.facility_id, o.date,
               cast(qty * 5 as decimal(24,4)) as fuel_consumption_mwh,
               cast(qty * 9 as decimal(24,4)) as renewable_electricity_mwh,
               cast(1000000 - (tax * 50000) // n as decimal(12,0)) * 0.000001 as cfe_pct,
               case when o.facility_id % 20 < 9 then cast(1050000 + (disc * 10000) // n as decimal(12,0)) * 0.000001 end as pue,
               cast(qty * 135 as decimal(24,4)) as water_withdrawal_gallons,
               cast(qty * 35 as decimal(24,4)) as water_discharge_gallons,
               cast(qty * 100 as decimal(24,4)) as water_consumption_gallons,
               cast((disc * 100000) // n as decimal(12,0)) * 0.000001 as water_replenishment_pct,
               cast(qty as decimal(24,4)) as waste_generated_tons,
               cast(kept as decimal(24,4)) as waste_diverted_tons,
               cast((kept * 1000000) // qty as decimal(12,0)) * 0.000001 as waste_diversion_pct,
               cast(qty * 10 as decimal(20,0)) * cast(coalesce(energy_price, 70) as decimal(6,2)) * 0.001 as energy_cost_usd,
               cast(qty * 100 as decimal(20,0)) * cast(coalesce(water_price, 8.5) as decimal(6,2)) * 0.001 as water_cost_usd,
               cast(qty + net as decimal(24,4)) * cast(coalesce(carbon_price, 0) as decimal(6,2)) * 0.001 as carbon_cost_usd
        from operations_base o join facilities f on o.facility_id = f.facility_id
             left join prices p on f.region = p.region""",
    "business": """
        select l_suppkey as facility_id, cast(date_trunc('month', l_shipdate) as date) as date,
               cast(sum(cast(l_extendedprice as decimal(14,2))) as decimal(20,2)) * 0.000001 as revenue_millions,
               count(*) as headcount, count(*) * 150 as square_feet, count(*) * 20 as server_count
        from lineitem where l_linestatus = 'F' group by 1, 2""",
    "combined": """
        select f.facility_id, f.facility_name, f.region, f.facility_type, e.date,
               e.scope1_tonnes, e.scope2_location_tonnes, e.scope2_market_tonnes, e.scope3_tonnes,
               e.total_emissions, e.electricity_mwh, e.renewable_pct,
               o.fuel_consumption_mwh, o.renewable_electricity_mwh, o.cfe_pct, o.pue,
               o.water_withdrawal_gallons, o.water_discharge_gallons, o.water_consumption_gallons,
               o.water_replenishment_pct, o.waste_generated_tons, o.waste_diverted_tons,
               o.waste_diversion_pct, o.energy_cost_usd, o.water_cost_usd, o.carbon_cost_usd
        from emis e join facilities f on e.facility_id = f.facility_id
             left join operations o on e.facility_id = o.facility_id and e.date = o.date""",
    "categories": """
        select * from (values (1, 'Purchased Goods & Services', 'Servers, equipment', cast(30 as double)),
            (2, 'Capital Goods', 'Data center construction', cast(40 as double)),
            (3, 'Fuel & Energy Related', 'Upstream electricity', cast(10 as double)),
            (4, 'Upstream Transportation', 'Logistics', cast(7 as double)),
            (6, 'Business Travel', 'Employee travel', cast(3 as double)),
            (7, 'Employee Commute', 'Commuting', cast(1 as double)),
            (11, 'Use of Sold Products', 'Cloud services', cast(8 as double)),
            (15, 'Investments', 'Portfolio', cast(1 as double)))
            t(category_id, category_name, description, typical_pct_of_scope3)""",
    "targets": """
        select 'Scope 1 & 2' as scope, 1995 as baseline_year, 2001 as target_year,
               cast(sum(scope1_tonnes) as double) + cast(sum(scope2_market_tonnes) as double) as baseline_emissions,
               cast(50 as double) as reduction_percent,
               (cast(sum(scope1_tonnes) as double) + cast(sum(scope2_market_tonnes) as double)) * 0.5::double as target_emissions,
               true as sbti_aligned
        from emissions where year(date) = 1995
        union all
        select 'Scope 3', 1995, 2001, cast(sum(scope3_tonnes) as double), cast(30 as double),
               cast(sum(scope3_tonnes) as double) * (1 - 30::double / 100), true
        from emissions where year(date) = 1995""",
    "initiatives": """
        select * from (values ('LED Lighting Upgrades', -45, 5, 2, 'Immediate'), ('HVAC Optimization', -30, 12, 5, '1 year'),
            ('Server Virtualization', -25, 8, 3, 'Immediate'), ('Renewable PPA (Wind)', 15, 150, 0, '2 years'),
            ('Hot Aisle Containment', 20, 10, 8, '1 year'), ('Free Cooling Systems', 35, 25, 15, '2-3 years'),
            ('On-site Solar', 50, 30, 25, '2-3 years'), ('Renewable PPA (Solar)', 45, 200, 0, '2 years'),
            ('Water Recycling', 40, 3, 4, '1-2 years'), ('Battery Storage', 75, 50, 40, '3-4 years'),
            ('Green Hydrogen', 150, 100, 200, '5+ years'), ('Direct Air Capture', 350, 500, 800, '5+ years'))
            t(initiative, cost_per_t, reduction_kt, capital_musd, timeframe)""",
}


def with_views(body: str, views: dict[str, str] | None = None) -> str:
    """Prefix the SQL with the common table expressions it mentions, directly or not."""
    known = VIEWS | (views or {})
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, sql in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(sql)
    ctes = ",\n".join(f"{name} as ({sql})" for name, sql in known.items() if name in needed)
    body = body.strip()
    if not ctes:
        return body
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"with {ctes}\n{body}"


def present(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Result columns as BIGINT, DOUBLE, text, date or boolean, some rounded."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        if digits and field.name in digits:
            c = F.round(c, digits[field.name])
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register ``fn(bound)`` under ``name`` with its SQL counterpart, if there is one."""

    def register(fn: Callable[[Bound], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: present(fn(Bound(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
