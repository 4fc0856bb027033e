from __future__ import annotations

import random
from decimal import Decimal

import pytest

from conftest import by, month
from scopeledger.model import lookups as L
from scopeledger.model.schemas import INITIATIVES
from scopeledger.operators.joins import literal_dim
from scopeledger.plans import finance as R


@pytest.fixture()
def initiatives(spark):
    return literal_dim(spark, L.INITIATIVE_ROWS, INITIATIVES)


def portfolios(spark, *rows):
    return spark.createDataFrame(list(rows), "p STRING, budget_musd DOUBLE, max_cost_per_t DOUBLE")


def offered(spark, initiatives, names):
    return spark.createDataFrame([(n,) for n in names], "p STRING").crossJoin(initiatives)


def test_abatement_curve(initiatives):
    got = R.macc(initiatives).orderBy("cost_per_t").collect()
    assert [r["cost_per_t"] for r in got] == [-45, -30, -25, 15, 20, 35, 40, 45, 50, 75, 150, 350]
    assert [r["cumulative_kt"] for r in got] == [5, 17, 25, 175, 185, 210, 213, 413, 443, 493, 593, 1093]
    assert [r["cost_band"] for r in got[2:4]] == ["saving", "low"] and got[8]["cost_band"] == "high"


@pytest.mark.parametrize("per_portfolio", [1000, 1])
def test_portfolio_selection(spark, initiatives, per_portfolio):
    plans = portfolios(spark, ("x", 100.0, 100.0), ("y", 10.0, 1000.0), ("z", 0.0, 0.0))
    selected = R.select_portfolio(offered(spark, initiatives, "xyz"), plans, ["p"], per_portfolio)
    got = by(R.portfolio_summary(selected, ["p"]), "p")
    assert (got["x"]["initiatives"], got["x"]["reduction_kt"], got["x"]["capital_musd"]) == (9, 443.0, 62.0)
    assert got["x"]["avg_cost_per_t"] == pytest.approx(13160 / 443)
    # 2 + 5 + 3 spend the budget; free contracts still fit
    assert (got["y"]["initiatives"], got["y"]["capital_musd"]) == (5, 10.0)
    assert "z" not in got


@pytest.mark.parametrize("per_portfolio", [1000, 1])
def test_greedy_skips_what_does_not_fit(spark, per_portfolio):
    items = [("p", f"i{n}", float(n), 1.0, cap, "1 year") for n, cap in enumerate([2.0, 5.0, 99.0, 3.0, 95.0, 90.0])]
    candidates = spark.createDataFrame(items, "p STRING, initiative STRING, cost_per_t DOUBLE, reduction_kt DOUBLE, capital_musd DOUBLE, timeframe STRING")
    got = R.select_portfolio(candidates, portfolios(spark, ("p", 100.0, 100.0)), ["p"], per_portfolio)
    assert sorted(r["initiative"] for r in got.collect()) == ["i0", "i1", "i3", "i5"]


ITEMS = "p STRING, initiative STRING, cost_per_t DOUBLE, reduction_kt DOUBLE, capital_musd DOUBLE, timeframe STRING"


def greedy(items, budget):
    """Names taken cheapest first while spent and capital together are at most the budget."""
    spent, taken = Decimal(0), []
    for it in sorted(items, key=lambda x: (x[2], x[1])):
        if spent + Decimal(str(it[4])) <= Decimal(str(budget)):
            spent += Decimal(str(it[4]))
            taken.append(it[1])
    return sorted(taken)


@pytest.mark.parametrize("per_portfolio", [1000, 1])
def test_fractional_exact_fits(spark, per_portfolio):
    candidates = spark.createDataFrame([(None, "a", 1.0, 1.0, 0.9, "1 year"), (None, "b", 2.0, 1.0, 0.1, "1 year")], ITEMS)
    got = R.select_portfolio(candidates, portfolios(spark, (None, 1.0, 100.0)), ["p"], per_portfolio)
    assert sorted(r["initiative"] for r in got.collect()) == ["a", "b"]


def test_both_ways_of_selecting_agree(spark):
    rng = random.Random(5)
    items = [
        (p, f"i{n:03}", float(rng.randrange(12)), 1.0, rng.choice([0.0, 0.1, 0.3, 0.7, 1.1, 2.9, 9.9]), "1 year")
        for p in ("x", "y", None) for n in range(40)
    ] + [("z", f"i{n:03}", float(n), 1.0, 1.0 if n % 2 else 100.0 - n / 10, "1 year") for n in range(40)]
    budgets = {"x": 5.5, "y": 30.3, None: 12.7, "z": 110.0}
    plans = portfolios(spark, *[(p, b, 1000.0) for p, b in budgets.items()])
    candidates = spark.createDataFrame(items, ITEMS)
    folded = R.select_portfolio(candidates, plans, ["p"])
    rounds = R.select_portfolio(candidates, plans, ["p"], 1)
    assert folded.schema == rounds.schema
    for df in (folded, rounds):
        rows = df.collect()
        for p, b in budgets.items():
            assert sorted(r["initiative"] for r in rows if r["p"] == p) == greedy([i for i in items if i[0] == p], b)


@pytest.mark.parametrize("per_portfolio", [1000, 1])
def test_one_portfolio_without_ids(spark, per_portfolio):
    items = [("p", f"i{n}", float(n), 1.0, cap, "1 year") for n, cap in enumerate([0.7, 0.2, 0.1, 0.05])]
    candidates = spark.createDataFrame(items, ITEMS).drop("p")
    plan = portfolios(spark, ("p", 1.0, 100.0)).drop("p")
    got = R.select_portfolio(candidates, plan, [], per_portfolio)
    assert sorted(r["initiative"] for r in got.collect()) == ["i0", "i1", "i2"]
    assert R.select_portfolio(candidates.limit(0), plan, [], per_portfolio).count() == 0


def test_abatement_by_year(spark, initiatives):
    selected = R.select_portfolio(offered(spark, initiatives, "x"), portfolios(spark, ("x", 100.0, 100.0)), ["p"])
    got = R.abatement_timeline(selected, ["p"]).orderBy("year").collect()
    assert [r["reduction_kt"] for r in got] == [13, 38, 443, 443, 443, 443]


def test_unlisted_timeframe_takes_two_years(spark):
    df = spark.createDataFrame([("5+ years",), ("Immediate",)], "timeframe STRING")
    assert {r["timeframe"]: r["duration"] for r in R.timeline(df).collect()} == {"5+ years": 2.0, "Immediate": 0.5}


def test_npv_of_escalating_savings(spark):
    project = spark.createDataFrame([("x", 1.0, 500.0)], "p STRING, capital_musd DOUBLE, savings_kusd DOUBLE")
    flows = R.cash_flows(project, ["p"])
    rates = spark.createDataFrame([(6.0,)], "discount_rate DOUBLE")
    got = R.npv(flows, ["p"], rates).first()
    assert got["npv_kusd"] == pytest.approx(3071.3285, abs=1e-3) and got["attractive"]
    last = flows.orderBy("year").collect()
    assert last[0]["cumulative"] == -1000 and last[-1]["cumulative"] == pytest.approx(-1000 + sum(500 * 1.02**t for t in range(1, 11)))


FIELDS = (
    "facility_id STRING, facility_type STRING, region STRING, date DATE, pue DOUBLE, cfe_pct DOUBLE, electricity_mwh DOUBLE, "
    "renewable_electricity_mwh DOUBLE, energy_cost_usd DOUBLE, water_consumption_gallons DOUBLE, water_cost_usd DOUBLE, "
    "scope1_tonnes DOUBLE, scope2_market_tonnes DOUBLE, total_emissions DOUBLE"
)


@pytest.fixture()
def base(spark):
    rows = []
    for m in range(24):
        pue, cfe = (1.20, 0.50) if m < 12 else (1.15, 0.60)
        rows.append(("a", "Data Center", "EU", month(m), pue, cfe, 1000.0, 500.0, 70.0, 4000.0, 2.0, 10.0, 90.0, 300.0))
        rows.append(("o", "Office", "EU", month(m), None, 0.2, 10.0, 5.0, 1.0, 40.0, 1.0, 1.0, 9.0, 30.0))
    return spark.createDataFrame(rows, FIELDS)


def test_base_slice_keeps_data_centres(base):
    assert R.base_slice(base).select("facility_type").distinct().first()["facility_type"] == "Data Center"


def upgrade(spark, target, capital=1.0, price=70.0):
    return spark.createDataFrame([(target, capital, price)], "target_pue DOUBLE, capital_musd DOUBLE, energy_price DOUBLE")


def test_pue_roi_annualises_and_fixes_units(spark, base):
    got = R.pue_roi(R.base_slice(base), upgrade(spark, 1.10)).first()
    assert got["electricity_mwh"] == 12000.0
    assert got["energy_saved_mwh"] == pytest.approx(12000 * 0.075)
    assert got["savings_kusd"] == pytest.approx(12000 * 0.075 * 70 / 1000)
    assert got["payback_years"] == pytest.approx(1000 / 63)
    old = R.pue_roi(R.base_slice(base), upgrade(spark, 1.10), compat=True).first()
    assert old["electricity_mwh"] == 24000.0 and old["payback_years"] == pytest.approx(1 / 126)


def test_no_savings_means_no_payback(spark, base):
    got = R.pue_roi(R.base_slice(base), upgrade(spark, 1.30)).first()
    assert got["payback_years"] == 999.0


def test_default_target_is_not_below_best_practice(spark, base):
    assert R.pue_roi(R.base_slice(base), upgrade(spark, None)).first()["target_pue"] == pytest.approx(1.155)


def test_payback_grid_size(spark):
    saved = spark.createDataFrame([(1000.0,)], "energy_saved_mwh DOUBLE")
    grid = R.payback_grid(saved, *R.default_price_grid(spark))
    assert grid.count() == 400
    got = grid.orderBy("energy_price", "capital_musd").first()
    assert got["payback_years"] == pytest.approx(500 / 40)


def test_ppa_and_break_even(spark, base):
    deal = spark.createDataFrame([(100.0, 90.0, 70.0, 50.0)], "target_renewable_pct DOUBLE, ppa_price DOUBLE, grid_price DOUBLE, carbon_price DOUBLE")
    roi = R.ppa_roi(R.base_slice(base), deal)
    got = roi.first()
    assert got["renewable_pct"] == 50.0 and got["extra_mwh"] == 500.0
    assert got["net_cost"] == pytest.approx(500 * 20 / 1000 - 175 * 50 / 1000)
    assert got["cost_per_tonne"] == pytest.approx(20 / 0.35)
    prices = spark.createDataFrame([(0.0,), (100.0,)], "sweep_price DOUBLE")
    sweep = by(R.carbon_price_sweep(roi, prices), "sweep_price")
    assert sweep[0.0]["net_cost"] == pytest.approx(10.0) and sweep[0.0]["break_even_price"] == pytest.approx(20 / 0.35)
    rows = {r["component"]: r["amount"] for r in R.cost_waterfall(roi).collect()}
    assert rows["Net Position"] == pytest.approx(sum(v for k, v in rows.items() if k != "Net Position"))


def test_water_roi(spark, base):
    plan = spark.createDataFrame([(30.0, 0.5, 8.5)], "reduction_pct DOUBLE, capital_musd DOUBLE, water_price DOUBLE")
    got = R.water_roi(R.base_slice(base), plan).first()
    assert got["water_saved"] == pytest.approx(1200.0)
    assert got["direct_kusd"] == pytest.approx(1.2 * 8.5 / 1000)


def test_carbon_cost(spark, base):
    prices = spark.createDataFrame(L.CARBON_SCENARIOS, "scenario STRING, price DOUBLE")
    got = by(R.carbon_cost_by_region(R.base_slice(base), prices), "scenario")
    assert got["Medium"]["monthly_cost_kusd"] == pytest.approx(5.0)
    assert by(R.carbon_cost_totals(R.carbon_cost_by_region(R.base_slice(base), prices)), "scenario")["High"]["annual_cost_musd"] == pytest.approx(0.12)


def test_history(base):
    dc = R.base_slice(base)
    trend = R.historical_trend(dc, 2020, 2021).first()
    assert trend["pue_change"] == pytest.approx(0.05) and trend["pue_status"] == "changed"
    roi = R.historical_roi(dc, 2020, 2021).first()
    assert roi["energy_saved_mwh"] == pytest.approx(12000 * 0.05 / 1.2)
    assert roi["pue_investment_kusd"] == pytest.approx(20.0)
    assert roi["total_investment_kusd"] == pytest.approx(120.0)
    assert roi["carbon_avoided_t"] == pytest.approx(12000 * 0.35 * 0.1)
    assert R.historical_roi(dc, 2020, 2020).count() == 0
    left = R.remaining_opportunity(dc, 2020, 2021).first()
    assert left["pue_gap"] == pytest.approx(0.07) and left["cfe_gap"] == pytest.approx(0.2)
    assert R.intensity_change(dc, 2020, 2021).first()["improvement_pct"] == pytest.approx(0.0)
