from __future__ import annotations

import numpy as np
import pytest

from conftest import by, month
from scopeledger.plans import forecast as P
from scopeledger.plans import series_models as M

WAVE = 10 * np.sin(np.arange(84) * 2 * np.pi / 12)


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, month(i), float(v)) for i, v in enumerate(values)], "k STRING, date DATE, y DOUBLE")


@pytest.mark.parametrize("model,params", [
    ("holt_winters", {}), ("holt_winters", {"damped": True}), ("trend_fourier", {}),
    ("trend_fourier", {"multiplicative": True, "quarterly": True, "level": 0.95}), ("sarima", {}),
    ("sarima", {"order": (2, 1, 1), "seasonal_order": (0, 1, 1)}),
])
def test_models_follow_trend_and_season(spark, model, params):
    truth = 200 + 0.8 * np.arange(108) + 10 * np.sin(np.arange(108) * 2 * np.pi / 12)
    series = frame(spark, truth[:84]).unionByName(frame(spark, 2 * truth[:84], "b"))
    got = P.fit_forecast(series, model, 24, params, ["k"])
    rows = by(got, "k", "step")
    assert len(rows) == 2 * 30
    for k, factor in (("a", 1), ("b", 2)):
        for step in range(-6, 24):
            r = rows[k, step]
            assert r["yhat"] == pytest.approx(factor * truth[84 + step], rel=0.06)
            assert r["lower"] <= r["yhat"] <= r["upper"] and r["is_future"] == (step >= 0)
    assert (rows["a", 0]["aic"] is not None) == (model == "sarima")
    score = by(P.accuracy(got, p=["k"]), "k")
    assert score["a"]["mape"] < 6 and score["a"]["accuracy_band"] == "excellent"


def test_random_walk_interval_widens():
    steps = np.random.default_rng(1).normal(0, 1, 120)
    got = M.sarima(100 + np.cumsum(steps), 12, (0, 1, 0), (0, 0, 0))
    width = got["upper"] - got["lower"]
    assert width[11] / width[0] == pytest.approx(np.sqrt(12), rel=1e-6)
    assert width[0] == pytest.approx(2 * 1.96 * steps[1:].std(), rel=0.05)


def test_ar1_coefficient_recovered():
    rng, w = np.random.default_rng(2), [0.0]
    for e in rng.normal(0, 1, 600):
        w.append(0.7 * w[-1] + e)
    got = M.sarima(np.array(w[1:]), 2, (1, 0, 0), (0, 0, 0))
    mean = np.mean(w[1:])
    assert (got["yhat"][0] - mean) / (w[-1] - mean) == pytest.approx(0.7, abs=0.1)


def test_short_series_do_not_fail():
    y = np.array([5.0, 6, 7, 8, 7, 6, 5, 4, 5, 6, 7, 8, 9])
    for fit in (M.holt_winters(y, 3), M.sarima(y, 3), M.trend_fourier(y, np.arange(13) * 30.0, np.arange(13, 16) * 30.0)):
        assert len(fit["yhat"]) == 3 and np.isfinite(fit["yhat"]).all()


def test_constant_series():
    for fit in (M.holt_winters(np.full(36, 4.0), 2), M.sarima(np.full(36, 4.0), 2), M.trend_fourier(np.full(36, 4.0), np.arange(36) * 30.0, np.arange(36, 38) * 30.0)):
        assert fit["yhat"] == pytest.approx([4.0, 4.0], abs=1e-3)


def test_short_series_are_left_out(spark):
    df = frame(spark, range(11)).unionByName(frame(spark, range(17), "b")).unionByName(frame(spark, range(24), "c"))
    df = df.withColumnRenamed("y", "total_emissions")
    prepared = P.prepare_series(df, "total_emissions", ["k"])
    assert {r["k"] for r in prepared.collect()} == {"b", "c"}
    fitted = P.fit_forecast(prepared, "holt_winters", 3, p=["k"])
    assert {r["k"] for r in fitted.collect()} == {"c"}


def test_fleet_series_without_key(spark):
    df = frame(spark, 100 + WAVE[:48]).withColumnRenamed("y", "total_emissions")
    got = P.fit_forecast(P.prepare_series(df, "total_emissions"), "holt_winters", 12)
    assert got.filter("is_future").count() == 12 and got.first()["series"] == "all"


def future(spark, values):
    rows = [(i, month(i), float(v), float(v) - 1, float(v) + 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "step INT, date DATE, yhat DOUBLE, lower DOUBLE, upper DOUBLE")


def test_scenario_schedule(spark):
    got = by(P.apply_scenarios(future(spark, [100.0] * 4), P.scenarios(spark), "total_emissions"), "scenario", "step")
    assert [got["Aggressive Decarbonization", i]["yhat"] for i in range(4)] == pytest.approx([100, 95, 90, 85])
    assert got["Aggressive Decarbonization", 3]["lower"] == pytest.approx(99 * 0.85)
    totals = by(P.compare_scenarios(P.apply_scenarios(future(spark, [100.0] * 4), P.scenarios(spark), "total_emissions")), "scenario")
    assert totals["Business as Usual"]["reduction"] == 0.0
    assert totals["Aggressive Decarbonization"]["reduction_pct"] == pytest.approx(7.5)
    one = P.apply_scenarios(future(spark, [100.0]), P.scenarios(spark), "total_emissions").collect()
    assert all(r["yhat"] == 100.0 for r in one)


def test_operational_scenarios(spark):
    pue = by(P.apply_scenarios(future(spark, [1.1] * 3), P.scenarios(spark), "pue"), "scenario", "step")
    assert pue["Efficiency Focus", 2]["yhat"] == pytest.approx(1.098)
    assert pue["Combined Strategy", 2]["yhat"] == pytest.approx(1.099)
    assert pue["Business as Usual", 2]["yhat"] == 1.1
    now = spark.createDataFrame([(0.4,)], "y DOUBLE")
    cfe = by(P.apply_scenarios(future(spark, [0.4] * 3), P.scenarios(spark), "cfe_pct", current=now), "scenario", "step")
    assert cfe["Aggressive Decarbonization", 2]["yhat"] == pytest.approx(0.8)
    assert cfe["Efficiency Focus", 2]["yhat"] == 0.4


def test_accuracy_measures(spark):
    df = spark.createDataFrame([(10.0, 9.0), (0.0, 3.0), (20.0, 22.0)], "y DOUBLE, yhat DOUBLE")
    got = P.accuracy(df).first()
    assert got["mae"] == pytest.approx(2.0) and got["rmse"] == pytest.approx(np.sqrt(14 / 3)) and got["mape"] == pytest.approx(10.0)


def test_summary_and_kpis(spark):
    history = frame(spark, range(100, 124))
    ahead = future(spark, [130.0, 150.0])
    got = P.forecast_summary(history.drop("k"), ahead).first()
    assert got["change"] == 27.0 and got["outlook"] == "intervention needed" and got["confidence"] == "high"
    kpi = P.series_kpis(history, ["k"]).first()
    assert (kpi["current_value"], kpi["mean_value"], kpi["trend"]) == (123.0, 111.5, "Increasing")
    assert kpi["yoy_pct"] == pytest.approx(12 / 111 * 100)


def test_series_of_one_batch_are_fitted_together_and_alike(spark, monkeypatch):
    """Many series share a batch and a fit; each gets the result it has alone."""
    rng = np.random.default_rng(5)
    ys = [50 + rng.normal(size=n).cumsum() for n in (60, 60, 60, 48, 60, 19, 60, 30)]
    ys[1][[14, 15, 33]] = ys[6][[20]] = np.nan
    sizes, smoothed = [], M._smoothed

    def counted(y, *rest):
        sizes.append(len(y))
        return smoothed(y, *rest)

    monkeypatch.setattr(M, "_smoothed", counted)
    together = M.holt_winters_many(ys, [6] * len(ys), damped=True)
    assert sorted(sizes) == [1, 1, 1, 5]
    for y, fit in zip(ys, together):
        alone = M.holt_winters(y, 6, damped=True)
        assert alone["spec"] == fit["spec"] and np.array_equal(alone["yhat"], fit["yhat"])
    monkeypatch.undo()
    rows = [(i, month(t), float(v)) for i, y in enumerate(ys) for t, v in enumerate(y) if not np.isnan(v)]
    frame_ = spark.createDataFrame(rows, "k INT, date DATE, y DOUBLE")
    got = by(P.fit_forecast(frame_, "holt_winters", 6, {"damped": True}, ["k"]), "k", "step")
    for i, y in enumerate(ys):
        if len(y) == 19:
            continue
        fit = M.holt_winters(y[:-6], 12, True)
        for step in range(-6, 6):
            assert got[i, step]["yhat"] == fit["yhat"][step + 6] and (got[i, step]["y"] is None) == (step >= 0)
    plan = P.fit_forecast(frame_, "holt_winters", 6, p=["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
