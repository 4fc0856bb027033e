"""Forecasting as registered queries.

The searches of the three fitted models have no SQL counterpart. Their parts
have: smoothing with given constants is a recursion, the ridge fit a set of
normal equations, and a seasonal autoregression of one coefficient has a closed
likelihood. The reports around them are checked on the straight-line forecast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.catalog.kpis import change_sql, mean_sql
from scopeledger.catalog.registry import query
from scopeledger.functions.scalars import total_emissions
from scopeledger.model.lookups import METRIC_ROWS
from scopeledger.operators.calendar import future_months, resample_monthly
from scopeledger.operators.reshape import unpivot_report
from scopeledger.plans import forecast as P
from scopeledger.plans import smoothing as S
from scopeledger.sources.binding import Bound
from scopeledger.sources.loaders import load_emissions

HORIZON = 24


def fleet(b: Bound, metric: str = "total_emissions") -> DataFrame:
    return P.prepare_series(b.combined(), metric)


def regional(b: Bound) -> DataFrame:
    return P.prepare_series(load_emissions(b.spark, b.tables()), "total_emissions", ["region"])


_KINDS = {row[0]: (row[2], row[3]) for row in METRIC_ROWS}


@query("f01_metric_series", "\nunion all ".join(
    f"select '{label}' as target, date, {mean_sql(c) if kind == 'mean' else f'cast(sum({c}) as double)'} as y from combined group by date"
    for label, (c, kind) in _KINDS.items()
))
def f01(b: Bound):
    wide = resample_monthly(b.combined(), "date", {c: (kind, c) for c, kind in _KINDS.values()})
    return unpivot_report(wide, ["date"], {c: label for label, (c, _) in _KINDS.items()}, "target", "y")


_REGIONAL = """
rm as (select region, date, sum(total_emissions) as y from emis e join facilities f on e.facility_id = f.facility_id group by 1, 2),
rs as (select *, row_number() over (partition by region order by date) - 1 as idx, row_number() over (partition by region order by date desc) as back,
              count(*) over (partition by region) as n from rm)"""


@query("f02_regional_series", "with " + _REGIONAL + " select region, date, cast(y as double) as y from rs where n >= 12")
def f02(b: Bound):
    return regional(b)


@query("f02_facility_series", """
with s as (select facility_id, min(date) as lo, max(date) as hi from emissions group by 1),
g as (select facility_id, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as date from s)
select g.facility_id, g.date, coalesce(cast(total_emissions as double), 0) as y
from g left join emis e on e.facility_id = g.facility_id and e.date = g.date""")
def f02_facility(b: Bound):
    return P.prepare_series(load_emissions(b.spark, b.tables()), "total_emissions", ["facility_id"])


@query("f03_train_test_split", "with " + _REGIONAL + """
select region, date, cast(y as double) as y, back <= 6 as is_test from rs""")
def f03(b: Bound):
    return P.split_tail(regional(b), 6, ["region"])


#: Months with holes: each facility misses every fifth month, and some have a short history.
_GAPPY = """
src as (select facility_id, date, cast(cfe_pct as double) as y from operations where (year(date) * 12 + month(date) + facility_id) % 5 <> 0),
rg as (select facility_id, min(date) as lo, max(date) as hi from src group by 1),
sp as (select facility_id, lo, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as date from rg),
o as (select sp.facility_id, datediff('month', lo, sp.date) as t, lo, y from sp left join src on src.facility_id = sp.facility_id and src.date = sp.date)"""


def gappy(b: Bound) -> DataFrame:
    return b.operations().filter((F.year("date") * 12 + F.month("date") + F.col("facility_id")) % 5 != 0)


_HISTORY = "date < case facility_id % 7 when 0 then date '1992-10-01' when 1 then date '1993-05-01' when 2 then date '1994-09-01' else date '2999-01-01' end"


@query("f02_series_coverage", "with " + _GAPPY.replace("where (", f"where {_HISTORY} and (") + """,
c as (select facility_id, count(y) as points, count(*) as months, min(lo) as first, max(lo + to_months(cast(t as integer))) as last from o group by 1)
select facility_id, points, months, months - points as missing, first, cast(last as date) as last,
       case when points < 12 then 'too_short' when points - 6 < 12 then 'not_fitted' when points - 19 < 24 then 'without_season' else 'fitted' end as status from c""")
def f02_coverage(b: Bound):
    return P.series_coverage(gappy(b).filter(_HISTORY), "cfe_pct", ["facility_id"])


_START = _GAPPY + """,
ln as (select facility_id, max(lo) as lo, max(t) + 1 as n from o group by 1),
ap as (select a.facility_id, avg(b.y - a.y) / 12 as s from o a join o b on a.facility_id = b.facility_id and b.t = a.t + 12 where a.t < 12 group by 1),
kn as (select * from o where y is not null),
wh as (select facility_id, (arg_max(y, t) - arg_min(y, t)) / greatest(max(t) - min(t), 1) as s from kn group by 1),
sl as (select wh.facility_id, coalesce(ap.s, wh.s) as s from wh left join ap on ap.facility_id = wh.facility_id),
hd as (select kn.facility_id, t % 12 as m, arg_min(y - s * t, t) as h from kn join sl on sl.facility_id = kn.facility_id group by 1, 2),
lv as (select facility_id, avg(h) as l from hd group by 1),
ss as (select lv.facility_id, l, list(coalesce(h - l, 0.0::double) order by k) as season
       from lv cross join (select unnest(range(12)) as k) left join hd on hd.facility_id = lv.facility_id and hd.m = k group by 1, 2),
hw as (
  select ss.facility_id, 0::bigint as t, a, b, g, phi, l - s as level, s as trend, season, 0.0::double as sse from ss join sl on sl.facility_id = ss.facility_id, cs
  union all
  select facility_id, t + 1, a, b, g, phi, l2, case when y is null then d else b * (l2 - level) + (1 - b) * d end,
         case when y is null then season else list_concat(list_concat(season[1:k], [g * (y - l2) + (1 - g) * season[k + 1]]), season[k + 2:12]) end,
         sse + coalesce((y - level - d - season[k + 1]) * (y - level - d - season[k + 1]), 0)
  from (select *, case when y is null then level + d else a * (y - season[k + 1]) + (1 - a) * (level + d) end as l2
        from (select hw.*, o.y, phi * trend as d, hw.t % 12 as k from hw join o on o.facility_id = hw.facility_id and o.t = hw.t)))"""


def constants(b: Bound, *grid: tuple[float, float, float, float]) -> DataFrame:
    return b.spark.createDataFrame(list(grid), "alpha DOUBLE, beta DOUBLE, gamma DOUBLE, phi DOUBLE")


@query("f04_fixed_constants", "with recursive cs as (select 0.3::double as a, 0.05::double as b, 0.2::double as g, 0.9::double as phi)," + _START + f""",
e as (select hw.*, n, lo from hw join ln on ln.facility_id = hw.facility_id and hw.t = ln.n),
f as (select *, level + phi * (1 - pow(phi, h)) / (1 - phi) * trend + season[(n + h - 1) % 12 + 1] as yhat from e, (select unnest(range(1, {HORIZON} + 1)) as h))
select facility_id, last_day(lo + to_months(cast(n + h - 1 as integer))) as date, h - 1 as step, round(yhat, 9) as yhat,
       round(yhat * (1 - 0.1::double), 9) as lower, round(yhat * (1 + 0.1::double), 9) as upper from f""", digits={"yhat": 9, "lower": 9, "upper": 9})
def f04_fixed(b: Bound):
    """Damped smoothing of series with missing months, as a fold over each series."""
    series = P.prepare_series(gappy(b), "cfe_pct", ["facility_id"])
    return S.smoothed_forecast(S.smooth(series, constants(b, (0.3, 0.05, 0.2, 0.9)), ["facility_id"]), HORIZON, ["facility_id"])


GRID = [(a, be, g, 1.0) for a in (0.05, 0.2, 0.5) for be in (0.0, 0.1) for g in (0.05, 0.3)]


@query("f04_best_constants", "with recursive cs as (select * from (values " + ", ".join(
    f"({a}::double, {be}::double, {g}::double, {phi}::double)" for a, be, g, phi in GRID
) + ") t(a, b, g, phi))," + _START + """,
e as (select hw.*, row_number() over (partition by hw.facility_id order by sse, a, b, g, phi) as nth from hw join ln on ln.facility_id = hw.facility_id and hw.t = ln.n)
select facility_id, a as alpha, b as beta, g as gamma, round(sse, 9) as sse from e where nth = 1""", digits={"sse": 9})
def f04_best(b: Bound):
    """The smoothing constants of least squared error of every facility, found without Python workers."""
    series = P.prepare_series(gappy(b), "cfe_pct", ["facility_id"])
    return S.best_constants(S.smooth(series, constants(b, *GRID), ["facility_id"]), ["facility_id"]).select("facility_id", "alpha", "beta", "gamma", "sse")


@query("f04_holt_winters_by_region", digits={"yhat": 2, "lower": 2, "upper": 2})
def f04(b: Bound):
    return P.fit_forecast(regional(b), "holt_winters", HORIZON, p=["region"])


@query("f04_holt_winters_damped_by_facility", digits={"yhat": 2, "lower": 2, "upper": 2})
def f04_damped(b: Bound):
    readings = b.emissions().withColumn("total_emissions", total_emissions())
    return P.fit_forecast(P.prepare_series(readings, "total_emissions", ["facility_id"]), "holt_winters", HORIZON, {"damped": True}, ["facility_id"])


@query("f05_trend_fourier_by_region", digits={"yhat": 2, "lower": 2, "upper": 2})
def f05(b: Bound):
    return P.fit_forecast(regional(b), "trend_fourier", HORIZON, p=["region"])


@query("f05_trend_fourier_multiplicative", digits={"yhat": 2, "lower": 2, "upper": 2})
def f05_multiplicative(b: Bound):
    params = {"multiplicative": True, "quarterly": True, "level": 0.95}
    return P.fit_forecast(regional(b), "trend_fourier", HORIZON, params, ["region"])


WAVES = ["sin1", "cos1", "sin2", "cos2"]
COLUMNS = ["one", "t", *WAVES]
PENALTIES = [0.0, 0.0, 0.1, 0.1, 0.1, 0.1]

_FEATURES = """
rm as (select region, date, """ + mean_sql("cfe_pct") + """ as y from combined group by 1, 2),
fe as (select region, date, y, 1.0::double as one, datediff('day', date '1970-01-01', date) / 365.25::double - 25 as t,
       datediff('day', date '1970-01-01', date) * 6.283185307179586::double / 365.25::double as w from rm where y is not null),
fx as (select *, sin(w) as sin1, cos(w) as cos1, sin(w * 2) as sin2, cos(w * 2) as cos2 from fe)"""


def features(b: Bound) -> DataFrame:
    series = S.wave_features(P.prepare_series(b.combined(), "cfe_pct", ["region"]))
    return series.withColumns({"one": F.lit(1.0), "t": F.unix_date("date") / F.lit(365.25) - 25})


@query("f05_features", "with " + _FEATURES + " select region, date, y, round(t, 9) as t, " + ", ".join(
    f"round({c}, 9) + 0.0::double as {c}" for c in WAVES) + " from fx", digits={c: 9 for c in ["t", *WAVES]})
def f05_features(b: Bound):
    return features(b).select("region", "date", "y", "t", *WAVES)


def _eliminated() -> str:
    """Normal equations of every region, one unknown eliminated in each step."""
    k = len(COLUMNS)
    cells = [f"sum({a} * {c}){f' + {PENALTIES[i]}' if i == j else ''} as a{i}{j}" for i, a in enumerate(COLUMNS) for j, c in enumerate(COLUMNS)]
    steps = [f"e0 as (select region, count(*) as n, {', '.join(cells)}, {', '.join(f'sum({a} * y) as a{i}{k}' for i, a in enumerate(COLUMNS))} from fx group by 1)"]
    for m in range(k):
        row = [f"a{m}{j} / a{m}{m} as a{m}{j}" for j in range(k + 1)]
        others = [f"a{i}{j} - a{i}{m} * a{m}{j} / a{m}{m} as a{i}{j}" for i in range(k) if i != m for j in range(k + 1)]
        steps.append(f"e{m + 1} as (select region, n, {', '.join(row + others)} from e{m})")
    return ",\n".join(steps)


@query("f05_ridge", "with " + _FEATURES + ",\n" + _eliminated() + " select region, n, " + ", ".join(
    f"round(a{i}{len(COLUMNS)}, 8) as b_{c}" for i, c in enumerate(COLUMNS)) + f" from e{len(COLUMNS)}", digits={f"b_{c}": 8 for c in COLUMNS})
def f05_ridge(b: Bound):
    return S.ridge(features(b), "y", COLUMNS, PENALTIES, ["region"])


@query("f06_seasonal_ar1", "with " + _FEATURES + """,
i as (select region, y, row_number() over (partition by region order by date) as t from fe),
m as (select region, avg(y) as mu, count(*) as n from i group by 1),
z as (select i.region, t, n, mu, y - mu as z, lag(y - mu, 12) over (partition by i.region order by t) as b from i join m on m.region = i.region),
q as (select region, max(n) as n, max(mu) as mu, sum(case when b is null then 0.75 * z * z else (z - 0.5 * b) * (z - 0.5 * b) end) / max(n) as v from z group by 1),
l as (select *, -0.5 * n * (ln(2 * pi() * v) + 1) + 6 * ln(0.75::double) as loglik from q)
select l.region, cast(z.t - l.n + 11 as bigint) as step, round(l.mu + 0.5 * z.z, 9) as yhat, round(l.mu + 0.5 * z.z + 1.959963984540054::double * sqrt(v), 9) as upper,
       round(loglik, 6) as loglik, round(4 - 2 * loglik, 6) as aic, '(0,0,0)(1,0,0,12)' as spec
from l join z on z.region = l.region where z.t > l.n - 12""", digits={"yhat": 9, "upper": 9, "loglik": 6, "aic": 6})
def f06_seasonal_ar1(b: Bound):
    """Likelihood and a year ahead of a seasonal autoregression with its coefficient given."""
    params = {"order": (0, 0, 0), "seasonal_order": (1, 0, 0), "fixed": {"seasonal_ar": [0.5]}}
    series = P.prepare_series(b.combined(), "cfe_pct", ["region"])
    got = P.fit_forecast(series, "sarima", 12, params, ["region"], test_size=0)
    return got.select("region", "step", "yhat", "upper", "loglik", "aic", "spec")


@query("f06_sarima_by_region", digits={"yhat": 2, "lower": 2, "upper": 2, "aic": 2, "bic": 2, "loglik": 2})
def f06(b: Bound):
    return P.fit_forecast(regional(b), "sarima", HORIZON, p=["region"])


@query("f07_trend_accuracy", "with " + _REGIONAL + """,
fit as (select region, regr_slope(cast(y as double), idx) as s, regr_intercept(cast(y as double), idx) as i from rs where back > 6 group by 1),
t as (select rs.region, cast(y as double) as y, i + s * idx as yhat from rs join fit on rs.region = fit.region where back <= 6),
a as (select region, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) * (y - yhat))) as rmse, avg(abs((y - yhat) / nullif(y, 0))) * 100 as mape from t group by 1)
select region, round(mae, 3) as mae, round(rmse, 3) as rmse, round(mape, 8) as mape,
       case when mape < 10 then 'excellent' when mape < 20 then 'good' else 'moderate' end as accuracy_band from a""",
       digits={"mae": 3, "rmse": 3, "mape": 8})
def f07(b: Bound):
    return P.accuracy(P.trend_test_predictions(regional(b), 6, ["region"]), p=["region"])


@query("f07_model_accuracy")
def f07_models(b: Bound):
    """Test error of the three fitted models, region by region."""
    series = regional(b)
    scored = [
        P.accuracy(P.fit_forecast(series, m, HORIZON, p=["region"]), p=["region"]).withColumn("model", F.lit(m))
        for m in ("holt_winters", "trend_fourier", "sarima")
    ]
    out = scored[0].unionByName(scored[1]).unionByName(scored[2])
    return out.select("model", "region", *[F.round(c, 2).alias(c) for c in ("mae", "rmse", "mape")], "accuracy_band")


_SCENARIOS = """
sc as (select * from (values ('Business as Usual', 1.0::double, 0.0::double, false), ('Aggressive Decarbonization', 0.85::double, 0.0005::double, true),
      ('Efficiency Focus', 0.90::double, 0.001::double, false), ('Combined Strategy', 0.80::double, 0.0005::double, false)) t(scenario, end_factor, pue_step, ramp))"""


def _line_sql(aggregate: str, where: str = "") -> str:
    """History, straight-line fit and its extension as CTEs h, fit and fc."""
    return f"""
h as (select date, {aggregate} as y from combined {where} group by date),
hi as (select date, cast(y as double) as y, row_number() over (order by date) - 1 as idx, row_number() over (order by date desc) as back from h where y is not null),
fit as (select regr_slope(y, idx) as s, regr_intercept(y, idx) as i, count(*) as n, max(date) as last_date,
               1.96::double * (select stddev_pop(y) from hi where back <= 12) as hw, (select arg_max(y, date) from hi) as now from hi),
fc as (select last_day(last_date + to_months(cast(step as integer))) as date, step - 1 as step, i + s * (n + step - 1) as yhat, hw, now
       from fit, (select unnest(range(1, {HORIZON} + 1)) as step))"""


def _line(b: Bound, metric: str) -> tuple[DataFrame, DataFrame]:
    history = fleet(b, metric)
    return history, P.extend_trend(history, HORIZON)


@query("f08_emission_scenarios", "with " + _line_sql("sum(total_emissions)") + "," + _SCENARIOS + f""",
a as (select *, 1 + (end_factor - 1) * step / {HORIZON - 1} as f from fc, sc)
select scenario, date, step, round(yhat * f, 2) as yhat, round((yhat - hw) * f, 2) as lower, round((yhat + hw) * f, 2) as upper from a""",
       digits={"yhat": 2, "lower": 2, "upper": 2})
def f08(b: Bound):
    return P.apply_scenarios(_line(b, "total_emissions")[1], P.scenarios(b.spark), "total_emissions")


@query("f09_pue_scenarios", "with " + _line_sql(mean_sql("pue")) + "," + _SCENARIOS + """
select scenario, date, step, round(yhat - step * pue_step, 8) as yhat, round(yhat - hw, 8) as lower, round(yhat + hw, 8) as upper from fc, sc""",
       digits={"yhat": 8, "lower": 8, "upper": 8})
def f09(b: Bound):
    return P.apply_scenarios(_line(b, "pue")[1], P.scenarios(b.spark), "pue")


@query("f10_cfe_scenarios", "with " + _line_sql(mean_sql("cfe_pct")) + "," + _SCENARIOS + f"""
select scenario, date, step, round(case when ramp then least(1, now + step * ((1 - now) / least(60, {HORIZON}))) else yhat end, 8) as yhat,
       round(yhat - hw, 8) as lower, round(yhat + hw, 8) as upper from fc, sc""", digits={"yhat": 8, "lower": 8, "upper": 8})
def f10(b: Bound):
    history, ahead = _line(b, "cfe_pct")
    current = history.agg(F.max_by("y", "date").alias("y"))
    return P.apply_scenarios(ahead, P.scenarios(b.spark), "cfe_pct", current=current)


@query("f11_scenario_comparison", "with " + _line_sql("sum(total_emissions)") + "," + _SCENARIOS + f""",
t as (select scenario, sum(yhat * (1 + (end_factor - 1) * step / {HORIZON - 1})) as total from fc, sc group by 1),
u as (select total as bau from t where scenario = 'Business as Usual')
select scenario, round(total, 1) as total, round(bau - total, 1) as reduction, round((bau - total) / bau * 100, 8) as reduction_pct from t, u""",
       digits={"total": 1, "reduction": 1, "reduction_pct": 8})
def f11(b: Bound):
    adjusted = P.apply_scenarios(_line(b, "total_emissions")[1], P.scenarios(b.spark), "total_emissions")
    return P.compare_scenarios(adjusted)


@query("f12_target_lines", """
with c as (select * from (values ('Total Emissions', 'total_emissions', 'Scope 1 & 2', 1.0::double, null), ('Scope 1 Emissions', 'scope1_tonnes', 'Scope 1 & 2', 0.05::double, null),
  ('Scope 2 Emissions', 'scope2_market_tonnes', 'Scope 1 & 2', 0.20::double, null), ('Scope 3 Emissions', 'scope3_tonnes', 'Scope 3', 0.75::double, null),
  ('PUE (Efficiency)', 'pue', null, null, 1.08::double), ('Water Consumption', 'water_consumption_gallons', null, null, null),
  ('Carbon-Free Energy %', 'cfe_pct', null, null, 1.0::double), ('Waste Diversion %', 'waste_diversion_pct', null, null, 0.90::double)) t(target, metric, target_scope, share, reference_line))
select target, metric, cast(target_year as bigint) as target_year, target_emissions * share / 12 as monthly_target, reference_line
from c left join targets g on g.scope = c.target_scope""")
def f12(b: Bound):
    return P.target_lines(b.spark, b.targets())


@query("f14_series_kpis", "with " + _REGIONAL + f""",
l as (select region, arg_max(y, date) as v, max(case when back = 13 then y end) as p, {mean_sql('y')} as m,
             regr_slope(cast(y as double), idx) as s from rs group by 1)
select region, cast(v as double) as current_value, {change_sql('v', 'p')} as yoy_pct, m as mean_value,
       case when s > 0 then 'Increasing' else 'Decreasing' end as trend from l""")
def f14(b: Bound):
    return P.series_kpis(regional(b), ["region"])


@query("f15_forecast_summary", "with " + _line_sql("sum(total_emissions)") + """,
a as (select max(now) as now, arg_max(yhat, date) as e, avg(2 * hw) / avg(yhat) * 100 as u from fc),
c as (select *, coalesce((e - now) / nullif(now, 0) * 100, 0) as p from a)
select now as current_value, round(e, 2) as end_value, round(u, 6) as uncertainty_pct, round(e - now, 2) as change, round(p, 6) as change_pct,
       case when u < 20 then 'high' when u < 40 then 'moderate' else 'low' end as confidence,
       case when p > 10 then 'intervention needed' when p > 0 then 'growing' else 'declining' end as outlook from c""",
       digits={"end_value": 2, "uncertainty_pct": 6, "change": 2, "change_pct": 6})
def f15(b: Bound):
    return P.forecast_summary(*_line(b, "total_emissions"))


@query("f16_future_months", """
with l as (select facility_id, max(date) as d from emissions group by 1)
select facility_id, step - 1 as step, last_day(d + to_months(cast(step as integer))) as date from l, (select unnest(range(1, 13)) as step)""")
def f16(b: Bound):
    return future_months(b.emissions(), "date", 12, ["facility_id"])


@query("f17_naive_band", "with " + _REGIONAL + """,
sg as (select region, 1.96::double * stddev_pop(cast(y as double)) as hw from rs where back <= 12 group by 1),
fit as (select region, regr_slope(cast(y as double), idx) as s, regr_intercept(cast(y as double), idx) as i, count(*) as n, max(date) as d from rs group by 1)
select fit.region, last_day(d + to_months(cast(step as integer))) as date, step - 1 as step, round(i + s * (n + step - 1), 2) as yhat,
       round(i + s * (n + step - 1) - hw, 2) as lower, round(i + s * (n + step - 1) + hw, 2) as upper
from fit join sg on sg.region = fit.region, (select unnest(range(1, 13)) as step)""", digits={"yhat": 2, "lower": 2, "upper": 2})
def f17(b: Bound):
    history = regional(b)
    return P.naive_band(P.extend_trend(history, 12, ["region"]), history, ["region"])
