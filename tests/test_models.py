"""Series models on calendars with holes, and their expression forms against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import by, month
from scopeledger.plans import forecast as P
from scopeledger.plans import series_models as M
from scopeledger.plans import smoothing as S
from scopeledger.plans import state_space as K

#: Share of the wave's height by which three missing months may move a forecast.
TOLERANCE = 0.02


def frame(spark, values, key="a"):
    rows = [(key, month(i), float(v)) for i, v in enumerate(values) if not np.isnan(v)]
    return spark.createDataFrame(rows, "k STRING, date DATE, y DOUBLE")


def wave(n):
    return 5 + 0.1 * np.sin(2 * np.pi * np.arange(n) / 12)


@pytest.mark.parametrize(("model", "tolerance"), [("holt_winters", TOLERANCE), ("trend_fourier", 0.15), ("sarima", TOLERANCE)])
def test_three_missing_months_do_not_bend_a_yearly_wave(spark, model, tolerance):
    holes = wave(60)
    holes[[13, 29, 40]] = np.nan
    series = frame(spark, holes).unionByName(frame(spark, wave(60), "b"))
    got = by(P.fit_forecast(series, model, 12, p=["k"], test_size=3), "k", "step")
    assert len(got) == 2 * 15
    for step in range(-3, 12):
        assert got["a", step]["yhat"] == pytest.approx(wave(72)[60 + step], abs=0.1 * tolerance), step
        assert got["a", step]["date"] == got["b", step]["date"] and got["a", step]["spec"]


def test_missing_months_at_the_end_of_training(spark):
    holes = wave(60)
    holes[[53, 54, 56]] = np.nan
    got = by(P.fit_forecast(frame(spark, holes), "holt_winters", 2, p=["k"], test_size=4), "step")
    assert sorted(got) == [-5, -3, -2, -1, 0, 1]
    for step, row in got.items():
        assert row["yhat"] == pytest.approx(wave(62)[60 + step], abs=0.1 * TOLERANCE)


def brute_loglik(y, phi, theta):
    """Likelihood of an ARMA(1,1) from the covariance matrix of the known months, shock variance concentrated out."""
    n, known = len(y), ~np.isnan(y)
    lags = np.arange(n)
    g = np.empty(n)
    g[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    g[1:] = (1 + phi * theta) * (phi + theta) / (1 - phi**2) * phi ** (lags[1:] - 1)
    cov = g[np.abs(lags[:, None] - lags[None, :])][np.ix_(known, known)]
    z, m = y[known], int(known.sum())
    variance = z @ np.linalg.solve(cov, z) / m
    return -0.5 * (m * (np.log(2 * np.pi * variance) + 1) + np.linalg.slogdet(cov)[1]), variance


def test_likelihood_with_missing_months_is_exact():
    y = np.random.default_rng(8).normal(0, 2, 40)
    y[[3, 4, 17, 38]] = np.nan
    model, free = K.fit(y, (1, 0, 1), (0, 0, 0), {"ar": [0.6], "ma": [-0.3]})
    loglik, variance, used, _, _ = model.filter(y)
    assert (loglik, variance) == pytest.approx(brute_loglik(y, 0.6, -0.3), rel=1e-9) and (used, free) == (36, 2)


def test_differenced_likelihood_equals_that_of_differences():
    y = np.cumsum(np.random.default_rng(9).normal(0, 1, 50))
    whole = K.fit(y, (1, 1, 0), (0, 0, 0), {"ar": [0.4]})[0].filter(y)
    plain = K.fit(np.diff(y), (1, 0, 0), (0, 0, 0), {"ar": [0.4]})[0].filter(np.diff(y))
    assert whole[:3] == pytest.approx(plain[:3], rel=1e-9)


def test_largest_likelihood_and_reported_orders():
    rng = np.random.default_rng(10)
    w = np.zeros(400)
    shocks = rng.normal(0, 1, 400)
    for t in range(1, 400):
        w[t] = 0.6 * w[t - 1] + shocks[t] + 0.4 * shocks[t - 1]
    model, _ = K.fit(w, (1, 0, 1), (0, 0, 0))
    assert model.ar[0] == pytest.approx(0.6, abs=0.12) and model.ma[0] == pytest.approx(0.4, abs=0.12)
    assert M.sarima(w[:30], 2)["spec"] == "(1,1,1)(0,0,0,12)" and M.sarima(w[:60], 2)["spec"] == "(1,1,1)(1,1,1,12)"
    mixed = M.trend_fourier(np.r_[w[:30], -1.0], np.arange(31) * 30.0, np.arange(2) + 1000.0, multiplicative=True)
    assert mixed["spec"].startswith("additive")


def test_smoothing_as_a_fold_equals_the_loop(spark):
    rng = np.random.default_rng(11)
    data = {"a": wave(50) + rng.normal(0, 0.01, 50), "b": rng.normal(5, 1, 17), "c": np.r_[1.0, np.full(8, np.nan), 3.0], "d": rng.normal(0, 1, 80)}
    data["a"][[0 + 4, 15, 16, 30]] = np.nan
    data["d"][rng.random(80) < 0.3] = np.nan
    data["d"][[0, -1]] = 1.0
    series = None
    for key, values in data.items():
        series = frame(spark, values, key) if series is None else series.unionByName(frame(spark, values, key))
    grid = spark.createDataFrame([(0.4, 0.1, 0.3, 1.0), (0.2, 0.05, 0.0, 0.9)], "alpha DOUBLE, beta DOUBLE, gamma DOUBLE, phi DOUBLE")
    states = S.smooth(series, grid, ["k"])
    got = by(S.smoothed_forecast(states.where("phi < 1"), 5, ["k"]), "k", "step")
    for row in states.collect():
        y = data[row.k]
        slope, head = M._start(y)
        level, trend, season, sse = np.nanmean(head) - slope, slope, np.nan_to_num(head - np.nanmean(head)), 0.0
        for t, v in enumerate(y):
            drift = row.phi * trend
            if np.isnan(v):
                level, trend = level + drift, drift
                continue
            sse += (v - level - drift - season[t % 12]) ** 2
            before, level = level, row.alpha * (v - season[t % 12]) + (1 - row.alpha) * (level + drift)
            trend = row.beta * (level - before) + (1 - row.beta) * drift
            season[t % 12] = row.gamma * (v - level) + (1 - row.gamma) * season[t % 12]
        assert (row.level, row.trend, row.sse, row.n) == pytest.approx((level, trend, sse, len(y)), abs=1e-9), row.k
        assert row.season == pytest.approx(season.tolist(), abs=1e-9)
        if row.phi < 1:
            for h in range(1, 6):
                point = level + sum(row.phi**i for i in range(1, h + 1)) * trend + season[(len(y) + h - 1) % 12]
                assert got[row.k, h - 1]["yhat"] == pytest.approx(point, abs=1e-9)
    best = by(S.best_constants(states, ["k"]), "k")
    assert all(best[r.k]["sse"] <= r.sse for r in states.collect()) and len(best) == 4
    assert S.smooth(series.limit(0), grid, ["k"]).count() == 0


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(12)
    x = np.c_[np.ones(40), rng.normal(0, 1, (40, 3))]
    y = x @ [1.0, 2.0, -3.0, 0.5] + rng.normal(0, 0.1, 40)
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("b", 1.0, 1.0, 1.0, 2.0, 1.0)] * 3 + [("a", 1.0, None, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "k STRING, one DOUBLE, p DOUBLE, q DOUBLE, r DOUBLE, y DOUBLE")
    xs, penalties = ["one", "p", "q", "r"], [0.0, 0.5, 0.5, 2.0]
    fitted = S.ridge(df, "y", xs, penalties, ["k"])
    got = by(fitted, "k")
    expected = np.linalg.solve(x.T @ x + np.diag(penalties), x.T @ y)
    assert [got["a"][f"b_{c}"] for c in xs] == pytest.approx(expected.tolist(), abs=1e-9) and got["a"]["n"] == 40
    assert S.ridge(df.where("k = 'b'"), "y", xs, [0.0] * 4, ["k"]).first()["b_p"] is None
    predicted = [r["yhat"] for r in S.predict(df.where("k = 'a' and p is not null"), fitted, xs, ["k"]).collect()]
    assert sorted(predicted) == pytest.approx(sorted((x @ expected).tolist()), abs=1e-9)


def test_every_series_is_accounted_for(spark):
    df = frame(spark, wave(11)).unionByName(frame(spark, wave(15), "b")).unionByName(frame(spark, wave(40), "c")).unionByName(frame(spark, wave(60), "d"))
    holes = df.where("not (k = 'd' and month(date) = 3)").withColumnRenamed("y", "pue")
    got = by(P.series_coverage(holes, "pue", ["k"]), "k")
    assert {k: r["status"] for k, r in got.items()} == {"a": "too_short", "b": "not_fitted", "c": "without_season", "d": "fitted"}
    assert (got["d"]["points"], got["d"]["months"], got["d"]["missing"]) == (55, 60, 5)
