"""Lookup tables, thresholds and published constants the results depend on."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

# --- fixed values: annual totals (tonnes, MWh, million gallons, tons); 2025 is a projection
ANNUAL_ROWS = [
    (2020, 55800.0, 5865100.0, 911600.0, 7770000.0, 8737400.0, 15166800.0, 181800.0, 3749.0, 0.00, 31500.0, 24900.0, 0.79),
    (2021, 64100.0, 6576200.0, 1823500.0, 8633000.0, 10520600.0, 18287100.0, 205200.0, 4562.0, 0.00, 43200.0, 35700.0, 0.83),
    (2022, 91200.0, 8045400.0, 2492100.0, 9317000.0, 11900300.0, 21776200.0, 374800.0, 5565.0, 0.06, 40300.0, 32700.0, 0.81),
    (2023, 79400.0, 9252900.0, 3423400.0, 10794000.0, 14296800.0, 25307000.0, 301200.0, 6352.0, 0.18, 52200.0, 43700.0, 0.84),
    (2024, 73100.0, 11283200.0, 3059100.0, 12053000.0, 15185200.0, 32179900.0, 289700.0, 8135.0, 0.64, 58500.0, 49200.0, 0.84),
    (2025, 70000.0, 12500000.0, 2800000.0, 13000000.0, 15870000.0, 35400000.0, 280000.0, 9000.0, 0.75, 62000.0, 52500.0, 0.85),
]

# --- fixed values: facilities (id, name, region, type)
FACILITY_ROWS = [
    ("DC-VA-001", "Virginia Data Center", "US-East", "Data Center"),
    ("DC-VA-002", "Virginia Data Center 2", "US-East", "Data Center"),
    ("DC-OR-001", "Oregon Data Center", "US-West", "Data Center"),
    ("DC-CA-001", "California Data Center", "US-West", "Data Center"),
    ("DC-TX-001", "Texas Data Center", "US-Central", "Data Center"),
    ("DC-IE-001", "Dublin Data Center", "EU", "Data Center"),
    ("DC-NL-001", "Amsterdam Data Center", "EU", "Data Center"),
    ("DC-SG-001", "Singapore Data Center", "APAC", "Data Center"),
    ("DC-JP-001", "Tokyo Data Center", "APAC", "Data Center"),
    ("OFF-WA-001", "Seattle Campus", "US-West", "Office"),
    ("OFF-CA-001", "San Francisco Office", "US-West", "Office"),
    ("OFF-NY-001", "New York Office", "US-East", "Office"),
    ("OFF-TX-001", "Austin Office", "US-Central", "Office"),
    ("OFF-UK-001", "London Office", "EU", "Office"),
    ("OFF-DE-001", "Berlin Office", "EU", "Office"),
    ("OFF-SG-001", "Singapore Office", "APAC", "Office"),
    ("MFG-CN-001", "Shenzhen Manufacturing", "APAC", "Manufacturing"),
    ("MFG-MX-001", "Tijuana Manufacturing", "US-Central", "Manufacturing"),
    ("MFG-VN-001", "Vietnam Manufacturing", "APAC", "Manufacturing"),
    ("MFG-PL-001", "Poland Manufacturing", "EU", "Manufacturing"),
]
FACILITY_START = date(2018, 1, 1)

# --- fixed values: data centre water use (million gallons) and PUE in the reference year 2024
SITE_2024_ROWS = [
    ("DC-VA-001", 191.6, 1.08),
    ("DC-VA-002", 158.2, 1.09),
    ("DC-OR-001", 361.4, 1.06),
    ("DC-CA-001", 0.0, 1.09),
    ("DC-TX-001", 182.3, 1.10),
    ("DC-IE-001", 0.1, 1.08),
    ("DC-NL-001", 330.0, 1.08),
    ("DC-SG-001", 18.2, 1.13),
    ("DC-JP-001", 0.0, 1.12),
]
REFERENCE_YEAR = 2024
PUE_STEP_PER_YEAR = 0.002
WITHDRAWAL_RATIO = Decimal("1.35")

# --- fixed values: per region CFE share, energy $/MWh, water $/kgal, carbon $/t
REGION_ROWS = [
    ("US-East", Decimal("0.68"), Decimal("65"), Decimal("8.5"), Decimal("0")),
    ("US-West", Decimal("0.87"), Decimal("85"), Decimal("12.0"), Decimal("25")),
    ("US-Central", Decimal("0.88"), Decimal("55"), Decimal("6.5"), Decimal("0")),
    ("EU", Decimal("0.83"), Decimal("120"), Decimal("10.0"), Decimal("85")),
    ("APAC", Decimal("0.12"), Decimal("95"), Decimal("7.0"), Decimal("5")),
]
REGION_SCHEMA = (
    "region STRING, cfe_share DECIMAL(4,2), energy_price DECIMAL(6,2), "
    "water_price DECIMAL(6,2), carbon_price DECIMAL(6,2)"
)
REGION_DEFAULTS = {
    "cfe_share": Decimal("0.65"), "energy_price": Decimal("70"),
    "water_price": Decimal("8.5"), "carbon_price": Decimal("0"),
}

# --- fixed values: share of the fleet total by facility type
TYPE_SHARES = [("Data Center", 0.85), ("Office", 0.10), ("Manufacturing", 0.05)]

# --- fixed values: emission factors
FACTOR_ROWS = [
    ("US Grid East", "Scope 2", 0.386, "kg CO2e/kWh", "EPA eGRID 2024", "US-East", 2024, date(2024, 1, 1)),
    ("US Grid West", "Scope 2", 0.203, "kg CO2e/kWh", "EPA eGRID 2024", "US-West", 2024, date(2024, 1, 1)),
    ("US Grid Central", "Scope 2", 0.390, "kg CO2e/kWh", "EPA eGRID 2024", "US-Central", 2024, date(2024, 1, 1)),
    ("EU Grid", "Scope 2", 0.295, "kg CO2e/kWh", "EEA 2024", "EU", 2024, date(2024, 1, 1)),
    ("APAC Grid", "Scope 2", 0.408, "kg CO2e/kWh", "Regional Average", "APAC", 2024, date(2024, 1, 1)),
    ("Natural Gas", "Scope 1", 56.1, "kg CO2e/MMBtu", "EPA GHG Inventory", "Global", 2024, date(2024, 1, 1)),
]

# --- fixed values: scope 3 categories
CATEGORY_ROWS = [
    (1, "Purchased Goods & Services", "Servers, equipment", 30.0, "Upstream"),
    (2, "Capital Goods", "Data center construction", 40.0, "Upstream"),
    (3, "Fuel & Energy Related", "Upstream electricity", 10.0, "Upstream"),
    (4, "Upstream Transportation", "Logistics", 7.0, "Upstream"),
    (6, "Business Travel", "Employee travel", 3.0, "Upstream"),
    (7, "Employee Commute", "Commuting", 1.0, "Upstream"),
    (11, "Use of Sold Products", "Cloud services", 8.0, "Downstream"),
    (15, "Investments", "Portfolio", 1.0, "Downstream"),
]

# --- fixed values: abatement initiatives (cost $/t, kt per year, M$, timeframe)
INITIATIVE_ROWS = [
    ("LED Lighting Upgrades", -45.0, 5.0, 2.0, "Immediate"),
    ("HVAC Optimization", -30.0, 12.0, 5.0, "1 year"),
    ("Server Virtualization", -25.0, 8.0, 3.0, "Immediate"),
    ("Renewable PPA (Wind)", 15.0, 150.0, 0.0, "2 years"),
    ("Hot Aisle Containment", 20.0, 10.0, 8.0, "1 year"),
    ("Free Cooling Systems", 35.0, 25.0, 15.0, "2-3 years"),
    ("On-site Solar", 50.0, 30.0, 25.0, "2-3 years"),
    ("Renewable PPA (Solar)", 45.0, 200.0, 0.0, "2 years"),
    ("Water Recycling", 40.0, 3.0, 4.0, "1-2 years"),
    ("Battery Storage", 75.0, 50.0, 40.0, "3-4 years"),
    ("Green Hydrogen", 150.0, 100.0, 200.0, "5+ years"),
    ("Direct Air Capture", 350.0, 500.0, 800.0, "5+ years"),
]
DURATION_ROWS = [
    ("Immediate", 0.5), ("1 year", 1.0), ("1-2 years", 1.5),
    ("2 years", 2.0), ("2-3 years", 2.5), ("3-4 years", 3.5),
]
DURATION_DEFAULT = 2.0

# --- fixed values: targets (scope, reduction percent), horizon in years
TARGET_CUTS = [("Scope 1 & 2", 50.0), ("Scope 3", 30.0)]
TARGET_HORIZON = 10

# --- fixed values: scenario multipliers and per-month operational steps
SCENARIO_ROWS = [
    ("Business as Usual", 1.0, 0.0, False),
    ("Aggressive Decarbonization", 0.85, 0.0005, True),
    ("Efficiency Focus", 0.90, 0.001, False),
    ("Combined Strategy", 0.80, 0.0005, False),
]
SCENARIO_SCHEMA = "scenario STRING, end_factor DOUBLE, pue_step DOUBLE, cfe_ramp BOOLEAN"
CFE_RAMP_MONTHS = 60

# --- fixed values: forecast targets (label, source, column, aggregate, reference line,
#     scope of the reduction target, share of that target)
METRIC_ROWS = [
    ("Total Emissions", "emissions", "total_emissions", "sum", None, "Scope 1 & 2", 1.0),
    ("Scope 1 Emissions", "emissions", "scope1_tonnes", "sum", None, "Scope 1 & 2", 0.05),
    ("Scope 2 Emissions", "emissions", "scope2_market_tonnes", "sum", None, "Scope 1 & 2", 0.20),
    ("Scope 3 Emissions", "emissions", "scope3_tonnes", "sum", None, "Scope 3", 0.75),
    ("PUE (Efficiency)", "operational", "pue", "mean", 1.08, None, None),
    ("Water Consumption", "operational", "water_consumption_gallons", "sum", None, None, None),
    ("Carbon-Free Energy %", "operational", "cfe_pct", "mean", 1.0, None, None),
    ("Waste Diversion %", "operational", "waste_diversion_pct", "mean", 0.90, None, None),
]
METRIC_SCHEMA = (
    "target STRING, source STRING, metric STRING, aggregate STRING, "
    "reference_line DOUBLE, target_scope STRING, target_share DOUBLE"
)

# --- fixed values: banding thresholds: name -> (cuts, labels, direction, inclusive)
BANDS = {
    "pue": ([1.10, 1.15], ["good", "fair", "poor"], "asc", False),
    "pue_projection": ([1.08, 1.10], ["exceeds best practice", "industry-leading", "accelerate"], "asc", False),
    "cfe_region": ([70, 40], ["good", "fair", "poor"], "desc", False),
    "cfe_current": ([70, 50], ["excellent", "good", "opportunity"], "desc", True),
    "replenishment": ([80, 50], ["excellent", "good", "opportunity"], "desc", True),
    "diversion": ([85, 75], ["excellent", "good", "opportunity"], "desc", True),
    "overall_score": ([80, 65], ["leader", "strong", "improve"], "desc", True),
    "mape": ([10, 20], ["excellent", "good", "moderate"], "asc", False),
    "uncertainty": ([20, 40], ["high", "moderate", "low"], "asc", False),
    "abatement_cost": ([0, 50], ["saving", "low", "high"], "asc", False),
    "forecast_change": ([10, 0], ["intervention needed", "growing", "declining"], "desc", False),
    "yoy": ([5], ["increased", "stable"], "desc", False),
}

# --- fixed values: prices, grid factors, score anchors
ENERGY_PRICE = 70.0
GRID_FACTOR = 0.35
PUE_CARBON_FACTOR = 0.3
PUMPING_KWH_PER_KGAL = 0.3
CARBON_VALUE = 50.0
EU_CARBON_VALUE = 85.0
BEST_PUE = 1.08
CFE_GOAL = 0.80
PUE_INVESTMENT_RATE = 400.0
RENEWABLE_CONTRACT_KUSD = 100.0
NO_PAYBACK_YEARS = 999.0
SWEEP_PRICES = [0.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0]
CARBON_SCENARIOS = [("Low", 25.0), ("Medium", 50.0), ("High", 100.0)]

#: Months of the seasonal uplift and its factors (energy, water)
SUMMER_MONTHS, SUMMER_FACTORS = [6, 7, 8], (1.03, 1.04)
WINTER_MONTHS, WINTER_FACTORS = [12, 1, 2], (1.02, 0.98)
