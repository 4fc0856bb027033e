"""Canonical table schemas (DDL strings) and their validation domains.

Amounts are DOUBLE in stored tables. Operators also accept DECIMAL measures and
then keep sums exact. Money columns hold thousands, water columns millions of
gallons, ``*_pct`` columns fractions 0-1 except ``renewable_pct`` (0-100).
"""

FACILITIES = """
    facility_id STRING, facility_name STRING, region STRING, facility_type STRING,
    operational_start_date DATE, typical_renewable_pct DOUBLE, relative_size STRING,
    annual_capacity_h2 DOUBLE
"""

EMISSIONS = """
    facility_id STRING, date DATE,
    scope1_tonnes DOUBLE, scope2_location_tonnes DOUBLE, scope2_market_tonnes DOUBLE,
    scope3_tonnes DOUBLE, electricity_mwh DOUBLE, renewable_pct DOUBLE,
    data_quality_flag STRING
"""

OPERATIONS = """
    facility_id STRING, date DATE,
    fuel_consumption_mwh DOUBLE, renewable_electricity_mwh DOUBLE, cfe_pct DOUBLE, pue DOUBLE,
    water_withdrawal_gallons DOUBLE, water_discharge_gallons DOUBLE,
    water_consumption_gallons DOUBLE, water_replenishment_pct DOUBLE,
    waste_generated_tons DOUBLE, waste_diverted_tons DOUBLE, waste_diversion_pct DOUBLE,
    energy_cost_usd DOUBLE, water_cost_usd DOUBLE, carbon_cost_usd DOUBLE
"""

BUSINESS = """
    facility_id STRING, date DATE, revenue_millions DOUBLE, headcount INT,
    square_feet INT, server_count INT, production_volume DOUBLE
"""

EMISSION_FACTORS = """
    factor_name STRING, scope STRING, emission_factor DOUBLE, unit STRING,
    source STRING, geography STRING, year INT, last_updated DATE
"""

TARGETS = """
    scope STRING, baseline_year INT, baseline_emissions DOUBLE, target_year INT,
    reduction_percent DOUBLE, target_emissions DOUBLE, sbti_aligned BOOLEAN
"""

CATEGORIES = """
    category_id INT, category_name STRING, description STRING,
    typical_pct_of_scope3 DOUBLE, upstream_downstream STRING
"""

INITIATIVES = """
    initiative STRING, cost_per_t DOUBLE, reduction_kt DOUBLE, capital_musd DOUBLE,
    timeframe STRING
"""

ANNUAL = """
    year INT, scope1 DOUBLE, scope2_location DOUBLE, scope2_market DOUBLE, scope3 DOUBLE,
    total DOUBLE, electricity DOUBLE, fuel DOUBLE, water DOUBLE, replenishment_pct DOUBLE,
    waste DOUBLE, diverted DOUBLE, diversion_pct DOUBLE
"""

FACILITY_TYPES = ["Data Center", "Office", "Manufacturing"]
RELATIVE_SIZES = ["Small", "Medium", "Large"]
QUALITY_FLAGS = ["Verified", "Estimated", "Flagged"]
SCOPES = ["Scope 1", "Scope 2", "Scope 3"]
STREAMS = ["Upstream", "Downstream"]

OPERATION_COLUMNS = [
    "fuel_consumption_mwh", "renewable_electricity_mwh", "cfe_pct", "pue",
    "water_withdrawal_gallons", "water_discharge_gallons", "water_consumption_gallons",
    "water_replenishment_pct", "waste_generated_tons", "waste_diverted_tons",
    "waste_diversion_pct", "energy_cost_usd", "water_cost_usd", "carbon_cost_usd",
]
