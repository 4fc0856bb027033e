"""Investment models. Parameters are scenario rows crossed with aggregated bases.

Money is in thousand $ unless a name ends in ``_musd``. Yearly figures divide by
the number of months observed. ``compat=True`` repeats two older conventions
instead: the whole history counts as a year, and thousands are read as millions
in paybacks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.aggregates import mean
from scopeledger.functions.scalars import clamp, label, month_start, named_band, pct_change, safe_div, year_of
from scopeledger.model import lookups as L
from scopeledger.operators.aggregates import mean_of_period_sums
from scopeledger.operators.filters import require, year_range
from scopeledger.operators.joins import (
    literal_dim, null_safe_join, number_grid, scenario_grid, with_constant_row,
)
from scopeledger.operators.ranking import with_order_stats
from scopeledger.operators.reshape import stack_rows
from scopeledger.session import settle

SITE = "Data Center"


def base_slice(combined: DataFrame) -> DataFrame:
    """Rows with electricity, PUE and energy cost: in effect the data centres."""
    return require(combined, ["electricity_mwh", "pue", "energy_cost_usd"])


def _months(compat: bool) -> Column:
    """Months to annualise over: those observed, or one year's worth under ``compat``."""
    return F.lit(12).cast("double") if compat else F.count_distinct("date").cast("double")


def _payback(capital_kusd: Column, yearly_kusd: Column) -> Column:
    return F.when(yearly_kusd > 0, safe_div(capital_kusd, yearly_kusd)).otherwise(L.NO_PAYBACK_YEARS)


# -- PUE --------------------------------------------------------------------


def pue_base(base: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Mean PUE, yearly electricity and energy cost of the data centres."""
    sites = base.filter(F.col("facility_type") == SITE)
    return sites.groupBy(*by).agg(
        mean("pue").alias("pue"),
        (F.sum("electricity_mwh").cast("double") / _months(compat) * 12).alias("electricity_mwh"),
        (F.sum("energy_cost_usd").cast("double") / _months(compat) * 12).alias("energy_cost_kusd"),
    )


def pue_roi(base: DataFrame, scenarios: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Savings of reaching a target PUE: scenario columns target_pue, capital_musd, energy_price.

    A NULL target means the default: best practice or 0.02 below today, whichever is higher.
    """
    one = scenario_grid(pue_base(base, by, compat), scenarios)
    target = F.coalesce("target_pue", F.greatest(F.lit(L.BEST_PUE), F.col("pue") - 0.02))
    one = one.withColumn("target_pue", target)
    saved = F.col("electricity_mwh") * (F.col("pue") - F.col("target_pue"))
    one = one.withColumn("energy_saved_mwh", saved)
    one = one.withColumn("savings_kusd", F.col("energy_saved_mwh") * F.col("energy_price") / 1000)
    capital = F.col("capital_musd") * (1 if compat else 1000)
    return one.select(
        *by, *scenarios.columns, "pue", "electricity_mwh", "energy_cost_kusd",
        (F.col("pue") - F.col("target_pue")).alias("pue_reduction"),
        (safe_div(F.col("pue") - F.col("target_pue"), "pue") * 100).alias("pue_reduction_pct"),
        "energy_saved_mwh", "savings_kusd",
        (F.col("energy_saved_mwh") * L.PUE_CARBON_FACTOR).alias("carbon_saved_t"),
        _payback(capital, F.col("savings_kusd")).alias("payback_years"),
    )


def cash_flows(
    projects: DataFrame, ids: Sequence[str], years: int = 10, escalation: float = 0.02, compat: bool = False
) -> DataFrame:
    """Year 0 outlay and escalating savings of each project with the running balance.

    ``projects`` carries capital_musd and savings_kusd.
    """
    scale = 1000 if compat else 1
    flows = projects.select(
        *ids, F.explode(F.sequence(F.lit(0), F.lit(years))).alias("year"), "capital_musd", "savings_kusd"
    )
    flow = F.when(F.col("year") == 0, -F.col("capital_musd") * 1000).otherwise(
        F.col("savings_kusd") * scale * F.pow(F.lit(1 + escalation), F.col("year"))
    )
    flows = flows.select(*ids, "year", flow.alias("cash_flow"))
    running = W.partitionBy(*ids).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    return flows.withColumn("cumulative", F.sum("cash_flow").over(running))


def npv(flows: DataFrame, ids: Sequence[str], rates: DataFrame) -> DataFrame:
    """Net present value of each project under each ``discount_rate`` (percent)."""
    discounted = F.col("cash_flow") / F.pow(1 + F.col("discount_rate") / 100, F.col("year"))
    return scenario_grid(flows, rates).groupBy(*ids, "discount_rate").agg(F.sum(discounted).alias("npv_kusd")).withColumn(
        "attractive", F.col("npv_kusd") > 0
    )


def payback_grid(savings: DataFrame, prices: DataFrame, capitals: DataFrame, compat: bool = False) -> DataFrame:
    """Payback years over energy price and capital; ``savings`` carries energy_saved_mwh."""
    grid = scenario_grid(savings, prices, capitals)
    yearly = F.col("energy_saved_mwh") * F.col("energy_price") / 1000
    capital = F.col("capital_musd") * (1 if compat else 1000)
    return grid.withColumn("payback_years", _payback(capital, yearly))


def default_price_grid(spark) -> tuple[DataFrame, DataFrame]:
    return number_grid(spark, "energy_price", 40.0, 120.0, 20), number_grid(spark, "capital_musd", 0.5, 2.0, 20)


# -- renewable power ----------------------------------------------------------


def ppa_base(base: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Mean monthly electricity, renewable share and scope 2."""
    return base.groupBy(*by).agg(
        (F.sum("electricity_mwh").cast("double") / _months(compat)).alias("monthly_mwh"),
        (safe_div(F.sum("renewable_electricity_mwh"), F.sum("electricity_mwh")) * 100).alias("renewable_pct"),
        safe_div(F.sum("scope2_market_tonnes"), F.count_distinct("date")).alias("monthly_scope2_t"),
    )


def ppa_roi(base: DataFrame, scenarios: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Cost of raising the renewable share: target_renewable_pct, ppa_price, grid_price, carbon_price."""
    one = scenario_grid(ppa_base(base, by, compat), scenarios)
    current = F.col("renewable_pct")
    whole = F.floor(current)
    default = F.when(current >= 99, F.lit(100.0)).otherwise(F.least(F.lit(100.0), (whole + 20).cast("double")))
    one = one.withColumn("target_renewable_pct", F.coalesce("target_renewable_pct", default))
    one = one.withColumn("extra_mwh", (F.col("target_renewable_pct") - current) / 100 * F.col("monthly_mwh"))
    one = one.withColumns({
        "ppa_cost": F.col("extra_mwh") * F.col("ppa_price") / 1000,
        "grid_cost": F.col("extra_mwh") * F.col("grid_price") / 1000,
        "carbon_avoided_t": F.col("extra_mwh") * L.GRID_FACTOR,
    })
    one = one.withColumn("carbon_value", F.col("carbon_avoided_t") * F.col("carbon_price") / 1000)
    premium = F.col("ppa_cost") - F.col("grid_cost")
    per_tonne = F.when(F.col("carbon_avoided_t") > 0, safe_div(premium, "carbon_avoided_t") * (1 if compat else 1000)).otherwise(0.0)
    return one.withColumn("net_cost", premium - F.col("carbon_value")).withColumn("cost_per_tonne", per_tonne)


def carbon_price_sweep(roi: DataFrame, prices: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Net cost under each ``sweep_price`` and the break-even price (NULL when already cheaper)."""
    premium = F.col("ppa_cost") - F.col("grid_cost")
    even = F.when(F.col("ppa_price") > F.col("grid_price"), safe_div(premium * 1000, "carbon_avoided_t"))
    return scenario_grid(roi, prices).select(
        *ids, "sweep_price", (premium - F.col("carbon_avoided_t") * F.col("sweep_price") / 1000).alias("net_cost"),
        even.alias("break_even_price"),
    )


def cost_waterfall(roi: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Cost, avoided grid cost, carbon value and net position as rows."""
    return stack_rows(roi, ids, ["component", "amount"], [
        [F.lit("Renewable Energy Cost"), F.col("ppa_cost")],
        [F.lit("Grid Cost Avoided"), -F.col("grid_cost")],
        [F.lit("Carbon Value"), -F.col("carbon_value")],
        [F.lit("Net Position"), F.col("net_cost")],
    ])


# -- water ----------------------------------------------------------------------


def water_roi(base: DataFrame, scenarios: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Savings of using less water: reduction_pct, capital_musd, water_price ($/kgal).

    Water quantities are taken as gallons; pumping saves 0.3 kWh per thousand.
    """
    sites = base.filter(F.col("facility_type") == SITE)
    one = sites.groupBy(*by).agg(
        (F.sum("water_consumption_gallons").cast("double") / _months(compat)).alias("monthly_water"),
        (F.sum("water_cost_usd").cast("double") / _months(compat)).alias("monthly_water_cost"),
    )
    one = scenario_grid(one, scenarios).withColumn("water_saved", F.col("monthly_water") * F.col("reduction_pct") / 100)
    one = one.withColumns({
        "direct_kusd": F.col("water_saved") / 1000 * F.col("water_price") / 1000,
        "energy_kusd": F.col("water_saved") * L.PUMPING_KWH_PER_KGAL / 1000
        / (1 if compat else 1000) * L.ENERGY_PRICE / 1000,
    })
    one = one.withColumn("monthly_savings_kusd", F.col("direct_kusd") + F.col("energy_kusd"))
    capital = F.col("capital_musd") * (1 if compat else 1000)
    return one.withColumn("annual_savings_kusd", F.col("monthly_savings_kusd") * 12).withColumns({
        "payback_years": _payback(capital, F.col("annual_savings_kusd")),
        "cost_per_kgal": safe_div(F.col("monthly_water_cost") * 1000, F.col("monthly_water") / 1000),
    })


# -- carbon price -----------------------------------------------------------------


def carbon_cost_by_region(base: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean monthly scope 1 + 2 of each region priced under each scenario."""
    monthly = base.withColumn("month", month_start("date"))
    level = mean_of_period_sums(monthly, ["region"], "month", ["scope1_tonnes", "scope2_market_tonnes", "total_emissions"])
    cost = (F.col("scope1_tonnes") + F.col("scope2_market_tonnes")) * F.col("price") / 1000
    return scenario_grid(level, prices).select(
        "region", "scenario", cost.alias("monthly_cost_kusd"), (cost * 12 / 1000).alias("annual_cost_musd")
    )


def carbon_cost_totals(by_region: DataFrame) -> DataFrame:
    return by_region.groupBy("scenario").agg(F.sum("annual_cost_musd").alias("annual_cost_musd"))


# -- abatement ----------------------------------------------------------------------


def macc(initiatives: DataFrame, p: Sequence[str] = ()) -> DataFrame:
    """Abatement cost curve: cumulative reduction in cost order, with cost band."""
    ordered = with_order_stats(initiatives, "cost_per_t", ["initiative"], True, p, amount="reduction_kt")
    return ordered.select(
        *initiatives.columns, F.col("running").alias("cumulative_kt"),
        named_band("cost_per_t", "abatement_cost").alias("cost_band"),
    )


#: Capital of an item, and sums of capital: decimals, so that an exact fit is one in any order of adding.
CAPITAL = "decimal(28,9)"
SPENT = "decimal(34,9)"
LAST = 2**63 - 1


def _beside(df: DataFrame, one_each: DataFrame, ids: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the one row of their portfolio; without ids there is one portfolio."""
    return null_safe_join(df, one_each, ids, how) if ids else with_constant_row(df, one_each)


def _feasible(candidates: DataFrame, portfolios: DataFrame, ids: Sequence[str]) -> DataFrame:
    if not ids:
        portfolios = portfolios.agg(F.min("budget_musd").alias("budget_musd"), F.min("max_cost_per_t").alias("max_cost_per_t"))
    exact = _beside(candidates, portfolios, ids).withColumns({
        "_capital": F.greatest(F.col("capital_musd"), F.lit(0)).cast(CAPITAL), "_budget": F.col("budget_musd").cast(SPENT),
    })
    return exact.filter(
        F.col("capital_musd").isNotNull() & (F.col("_capital") <= F.col("_budget")) & (F.col("cost_per_t") <= F.col("max_cost_per_t"))
    )


def select_portfolio(
    candidates: DataFrame, portfolios: DataFrame, ids: Sequence[str], per_portfolio: int = 1000
) -> DataFrame:
    """Cheapest-first selection within a budget, skipping what no longer fits.

    ``portfolios`` holds ids, budget_musd and max_cost_per_t; ``candidates`` the
    same ids with the initiatives open to each. An item is taken if what is spent
    so far and its capital are at most the budget, in exact decimals; a negative
    capital counts as none. NULL is an id like any other; without ids there is
    one portfolio, with the least budget and cost limit given. Portfolios of up to
    ``per_portfolio`` feasible items are folded as arrays, many at once; larger
    ones are selected in rounds of distributed prefix sums by the same rule.
    """
    ids = list(ids)
    feasible = settle(_feasible(candidates, portfolios, ids))
    sizes = feasible.groupBy(*ids).agg(F.count(F.lit(1)).alias("_items"))
    large = settle(sizes.filter(F.col("_items") > per_portfolio).drop("_items") if ids else sizes.filter(F.col("_items") > per_portfolio))
    if large.isEmpty():
        return _select_by_fold(feasible, ids)
    if not ids:
        return _select_by_rounds(feasible, ids)
    big_rows = null_safe_join(feasible, large, ids, "left_semi")
    small_rows = null_safe_join(feasible, large, ids, "left_anti")
    return _select_by_fold(small_rows, ids).unionByName(_select_by_rounds(big_rows, ids))


ITEM = ["cost_per_t", "initiative", "reduction_kt", "capital_musd", "timeframe"]


def _select_by_fold(feasible: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One array per portfolio, walked in cost order with the capital spent as state."""
    item = F.struct(*ITEM, "_capital")
    lists = feasible.groupBy(*ids).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.max("_budget").alias("budget")
    )
    taken_type = (
        "array<struct<cost_per_t:double,initiative:string,reduction_kt:double,capital_musd:double,timeframe:string,"
        f"_capital:{CAPITAL}>>"
    )
    start = F.struct(F.lit(0).cast(SPENT).alias("spent"), F.array().cast(taken_type).alias("taken"))

    def step(state: Column, x: Column) -> Column:
        spent = (state["spent"] + x["_capital"]).cast(SPENT)
        fits = spent <= F.col("budget")
        return F.struct(
            F.when(fits, spent).otherwise(state["spent"]).alias("spent"),
            F.when(fits, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"),
        )

    walked = lists.select(*ids, F.aggregate("items", start, step)["taken"].alias("taken"))
    return walked.select(*ids, F.inline("taken")).select(*ids, *ITEM)


def _select_by_rounds(feasible: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rounds that each halve what is left of the budget, so there are at most about a hundred.

    While at least half of it is left, every item under that half fits and is
    taken. A round ends at the first item that brings the rest below the half:
    such a small one, or a larger one that still fits. Items are numbered once;
    a portfolio's rounds are kept as spans of numbers, one small row each.
    """
    ordered = settle(
        with_order_stats(feasible, "cost_per_t", ITEM[1:], True, ids, amount="_capital").select(
            *ids, *ITEM, "_capital", "_budget", F.col("row_no").alias("_pos")
        )
    )
    no_span = F.array().cast(f"array<struct<after:bigint,upto:bigint,below:{SPENT},also:bigint>>")
    open_ = ordered.groupBy(*ids).agg(F.max("_budget").alias("_left")).select(
        *ids, "_left", F.lit(0).cast("long").alias("_after"), no_span.alias("_spans")
    )
    half = F.greatest((F.col("_left") / 2).cast(SPENT), F.lit("0.000000001").cast(SPENT))
    small = F.col("_capital") < half
    rest = (F.col("_left") - F.col("running").cast(SPENT)).cast(SPENT)
    ends = (small & (F.col("_capital") > 0) & (rest < half)) | (~small & (F.col("_capital") <= rest))
    left = F.when(small, rest).otherwise((rest - F.col("_capital")).cast(SPENT))
    turn = F.struct("_pos", left.alias("left"), small.alias("small"))
    span = F.struct(
        F.col("_after").alias("after"), F.coalesce("_turn._pos", F.lit(LAST)).alias("upto"), half.alias("below"),
        F.when(~F.col("_turn.small"), F.col("_turn._pos")).alias("also"),
    )
    finished: DataFrame | None = None
    while not open_.isEmpty():
        ahead = _beside(ordered, open_.drop("_spans"), ids).filter(F.col("_pos") > F.col("_after"))
        steps = ahead.withColumn("_step", F.when(small, F.col("_capital")).otherwise(F.lit(0)).cast(CAPITAL))
        steps = with_order_stats(steps, "_pos", [], True, ids, amount="_step")
        turns = steps.groupBy(*ids).agg(F.min(F.when(ends, turn)).alias("_turn"))
        walked = settle(_beside(open_, turns, ids, "left").withColumn("_spans", F.concat("_spans", F.array(span))))
        done = walked.filter(F.col("_turn").isNull()).select(*ids, "_spans")
        finished = done if finished is None else finished.unionByName(done)
        open_ = walked.filter(F.col("_turn").isNotNull()).select(
            *ids, F.col("_turn.left").alias("_left"), F.col("_turn._pos").alias("_after"), "_spans"
        )
    if finished is None:
        return feasible.select(*ids, *ITEM)
    inside = F.exists("_spans", lambda s: (F.col("_pos") > s["after"]) & (F.col("_pos") <= s["upto"]) & (
        (F.col("_capital") < s["below"]) | F.col("_pos").eqNullSafe(s["also"])
    ))
    return _beside(ordered, finished, ids).filter(inside).select(*ids, *ITEM)


def portfolio_summary(selected: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Count, reduction, capital and reduction-weighted cost of each portfolio."""
    return selected.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("initiatives"), F.sum("reduction_kt").alias("reduction_kt"),
        F.sum("capital_musd").alias("capital_musd"),
        safe_div(F.sum(F.col("cost_per_t") * F.col("reduction_kt")), F.sum("reduction_kt")).alias("avg_cost_per_t"),
    )


def timeline(selected: DataFrame) -> DataFrame:
    """Years each initiative takes; an unlisted timeframe counts two."""
    durations = literal_dim(selected.sparkSession, L.DURATION_ROWS, "timeframe STRING, duration DOUBLE")
    joined = selected.join(F.broadcast(durations), "timeframe", "left")
    return joined.withColumn("duration", F.coalesce("duration", F.lit(L.DURATION_DEFAULT)))


def abatement_timeline(selected: DataFrame, ids: Sequence[str], years: int = 5) -> DataFrame:
    """Reduction in force in each year: an initiative counts from its last whole year of work on."""
    done = timeline(selected).withColumn("_from", F.floor("duration").cast("int")).filter(F.col("_from") <= years)
    active = done.select(*ids, "reduction_kt", F.explode(F.sequence("_from", F.lit(years))).alias("year"))
    # every portfolio lists every year, also those before anything is finished
    spine = selected.select(*ids).distinct().select(*ids, F.explode(F.sequence(F.lit(0), F.lit(years))).alias("year"))
    sums = active.groupBy(*ids, "year").agg(F.sum("reduction_kt").alias("reduction_kt"))
    joined = null_safe_join(spine, sums, [*ids, "year"], "left")
    return joined.withColumn("reduction_kt", F.coalesce("reduction_kt", F.lit(0.0)))


# -- history ----------------------------------------------------------------------


def yearly_base(base: DataFrame, first: int, last: int, by: Sequence[str] = ()) -> DataFrame:
    return year_range(base, first, last).groupBy(*by, year_of("date").alias("year")).agg(
        mean("pue").alias("pue"), mean("cfe_pct").alias("cfe_pct"),
        F.sum("water_consumption_gallons").alias("water"), F.sum("electricity_mwh").alias("electricity"),
        F.sum("total_emissions").alias("emissions"), F.sum("energy_cost_usd").alias("energy_cost"),
        F.sum("water_cost_usd").alias("water_cost"),
    )


def _first_last_year(yearly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    columns = ["pue", "cfe_pct", "water", "electricity", "emissions"]
    picks = [F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n_years")]
    for c in columns:
        picks += [
            F.min_by(c, "year").cast("double").alias(f"first_{c}"), F.max_by(c, "year").cast("double").alias(f"last_{c}"),
        ]
    ends = yearly.groupBy(*by).agg(*picks).filter(F.col("n_years") >= 2)
    return ends.withColumns({
        "pue_change": F.col("first_pue") - F.col("last_pue"),
        "cfe_change": F.col("last_cfe_pct") - F.col("first_cfe_pct"),
        "water_change": F.col("last_water") - F.col("first_water"),
    })


def historical_trend(base: DataFrame, first: int, last: int, by: Sequence[str] = ()) -> DataFrame:
    """First to last year: PUE, CFE, water, electricity."""
    e = _first_last_year(yearly_base(base, first, last, by), by)
    return e.select(
        *by, "first_year", "last_year", (F.col("last_year") - F.col("first_year")).alias("years_span"),
        "first_pue", "last_pue", "pue_change",
        label([(F.abs("pue_change") > 0.005, "changed")], "stable").alias("pue_status"),
        "cfe_change", "water_change", pct_change("last_water", "first_water").alias("water_change_pct"),
        pct_change("last_electricity", "first_electricity").alias("electricity_change_pct"),
    )


def _site_count(base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sites = base.filter(F.col("facility_type") == SITE).select(*by, "facility_id").distinct()
    return sites.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sites"))


def _with_sites(e: DataFrame, base: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = _site_count(base, by)
    return null_safe_join(e, counts, by, "left") if by else with_constant_row(e, counts)


def historical_roi(base: DataFrame, first: int, last: int, by: Sequence[str] = ()) -> DataFrame:
    """Return on the PUE and CFE gains made, with estimated investments (thousand $)."""
    e = _with_sites(_first_last_year(yearly_base(base, first, last, by), by), base, by)
    pue_gain, cfe_gain = F.col("pue_change") > 0.01, F.col("cfe_change") > 0.05
    e = e.withColumn("energy_saved_mwh", F.when(pue_gain, F.col("last_electricity") * safe_div("pue_change", "first_pue")))
    e = e.withColumns({
        "energy_savings_kusd": F.col("energy_saved_mwh") * L.ENERGY_PRICE / 1000,
        "pue_investment_kusd": F.when(pue_gain, F.col("pue_change") * L.PUE_INVESTMENT_RATE * F.col("n_sites")),
        "carbon_avoided_t": F.when(cfe_gain, F.col("last_electricity") * L.GRID_FACTOR * F.col("cfe_change")),
        "contract_kusd": F.when(cfe_gain, F.lit(L.RENEWABLE_CONTRACT_KUSD)),
    })
    zero = F.lit(0.0)
    e = e.withColumn("carbon_value_kusd", F.col("carbon_avoided_t") * L.CARBON_VALUE / 1000)
    e = e.withColumns({
        "total_investment_kusd": F.coalesce("pue_investment_kusd", zero) + F.coalesce("contract_kusd", zero),
        "total_returns_kusd": F.coalesce("energy_savings_kusd", zero) + F.coalesce("carbon_value_kusd", zero),
    })
    return e.select(
        *by, "first_year", "last_year", "n_sites", "pue_change", "cfe_change",
        (F.col("water_change") < 0).alias("water_reduced"),
        "energy_saved_mwh", "energy_savings_kusd", "pue_investment_kusd",
        safe_div("pue_investment_kusd", "energy_savings_kusd").alias("pue_payback_years"),
        (safe_div("energy_savings_kusd", "pue_investment_kusd") * 100).alias("pue_roi_pct"),
        "carbon_avoided_t", "carbon_value_kusd",
        (F.col("carbon_avoided_t") * L.EU_CARBON_VALUE / 1000).alias("carbon_value_eu_kusd"),
        "total_investment_kusd", "total_returns_kusd",
        F.when(F.col("total_returns_kusd") > 0, safe_div("total_investment_kusd", "total_returns_kusd")).alias("payback_years"),
    )


def intensity_change(base: DataFrame, first: int, last: int, by: Sequence[str] = ()) -> DataFrame:
    """Emissions per MWh (kg), first against last year."""
    e = _first_last_year(yearly_base(base, first, last, by), by).withColumns({
        "first_intensity": safe_div("first_emissions", "first_electricity") * 1000,
        "last_intensity": safe_div("last_emissions", "last_electricity") * 1000,
    })
    better = safe_div(F.col("first_intensity") - F.col("last_intensity"), "first_intensity") * 100
    return e.select(
        *by, "first_intensity", "last_intensity", better.alias("improvement_pct"),
        label([(better > 0, "improved")], "maintained").alias("status"),
    )


def remaining_opportunity(
    base: DataFrame, first: int, last: int, best_pue: float = L.BEST_PUE, cfe_goal: float = L.CFE_GOAL,
    by: Sequence[str] = (),
) -> DataFrame:
    """What reaching best-practice PUE and the CFE goal would still bring; zero when reached."""
    e = _with_sites(_first_last_year(yearly_base(base, first, last, by), by), base, by)
    e = e.withColumns({
        "pue_gap": clamp(F.col("last_pue") - best_pue, lo=0.0), "cfe_gap": clamp(cfe_goal - F.col("last_cfe_pct"), lo=0.0),
    })
    e = e.withColumns({
        "energy_mwh": F.col("last_electricity") * safe_div("pue_gap", "last_pue"),
        "carbon_t": F.col("last_electricity") * L.GRID_FACTOR * F.col("cfe_gap"),
    })
    return e.select(
        *by, "last_pue", "pue_gap", "energy_mwh", (F.col("energy_mwh") * L.ENERGY_PRICE / 1000).alias("energy_kusd"),
        (F.col("pue_gap") * L.PUE_INVESTMENT_RATE * F.col("n_sites")).alias("investment_kusd"),
        "last_cfe_pct", "cfe_gap", "carbon_t", (F.col("carbon_t") * L.CARBON_VALUE / 1000).alias("carbon_kusd"),
    )


def efficiency_impact(combined: DataFrame, last_year: int) -> DataFrame:
    """Value of the PUE and CFE gains since the first year; NULL where there was none."""
    from scopeledger.plans.kpis import k21_improvements

    e = k21_improvements(combined, last_year)
    pue, cfe, mwh = F.col("pue_improvement"), F.col("cfe_improvement"), F.col("last_electricity_mwh")
    saved = F.when(pue > 0, mwh * safe_div(pue, "first_pue"))
    avoided = F.when(cfe > 0, mwh * L.GRID_FACTOR * cfe)
    return e.select(
        "first_year", "last_year", pue, saved.alias("energy_saved_mwh"),
        (saved * L.ENERGY_PRICE / 1000).alias("annual_savings_kusd"),
        (saved / 12 * L.ENERGY_PRICE / 1000).alias("monthly_savings_kusd"),
        (saved * L.GRID_FACTOR).alias("pue_avoided_t"), cfe, avoided.alias("cfe_avoided_t"),
        (avoided * L.CARBON_VALUE / 1000).alias("carbon_value_kusd"),
        (avoided * L.EU_CARBON_VALUE / 1000).alias("eu_value_kusd"),
    )


