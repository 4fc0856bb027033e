"""Seasonal ARIMA by its exact likelihood: a Kalman filter over calendar months that steps over missing ones.

The state holds the stationary part and the earlier levels that differencing
needs, so a missing month is a month without update, not a lost difference.
Levels before the first filtered month are known where observed and vague
otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEASON = 12
VAGUE = 1e6
TINY = 1e-12


def from_partial(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from its partial autocorrelations."""
    out = np.empty(0)
    for r in partial:
        out = np.r_[out - r * out[::-1], r]
    return out


def polynomial(short: np.ndarray, seasonal: np.ndarray, sign: float) -> np.ndarray:
    """Coefficients at lags 1, 2, ... of a product of a short and a seasonal lag polynomial."""
    wide = np.zeros(SEASON * len(seasonal) + 1)
    wide[0], wide[SEASON::SEASON] = 1.0, sign * np.asarray(seasonal)
    return sign * np.convolve(np.r_[1.0, sign * np.asarray(short)], wide)[1:]


def stationary_covariance(transition: np.ndarray, shock: np.ndarray) -> np.ndarray:
    """Sum of ``T^k R R' T'^k``, in doubling steps."""
    total, power = np.outer(shock, shock), transition
    for _ in range(60):
        more = power @ total @ power.T
        total = total + more
        if np.abs(more).max() <= 1e-13 * np.abs(total).max():
            break
        power = power @ power
    return total


@dataclass
class Model:
    """Transition, shock and observation of a seasonal ARIMA with given coefficients."""

    ar: np.ndarray
    ma: np.ndarray
    difference: np.ndarray

    def __post_init__(self) -> None:
        r, lags = max(len(self.ar), len(self.ma) + 1), len(self.difference)
        inner = np.zeros((r, r))
        inner[: len(self.ar), 0] = self.ar
        inner[np.arange(r - 1), np.arange(1, r)] = 1.0
        self.r = r
        self.transition = np.zeros((r + lags, r + lags))
        self.transition[:r, :r] = inner
        self.shock = np.zeros(r + lags)
        self.shock[0], self.shock[1 : len(self.ma) + 1] = 1.0, self.ma
        self.observe = np.zeros(r + lags)
        self.observe[0], self.observe[r:] = 1.0, self.difference
        if lags:
            self.transition[r] = self.observe
            at = np.arange(1, lags)
            self.transition[r + at, r + at - 1] = 1.0
        self.start = stationary_covariance(inner, self.shock[:r])

    def filter(self, y: np.ndarray) -> tuple[float, float, int, np.ndarray, np.ndarray]:
        """Log-likelihood, shock variance, months used, and state and covariance (in units of it) after the last month."""
        lags = len(self.difference)
        state, cov = np.zeros(self.r + lags), np.zeros((self.r + lags, self.r + lags))
        cov[: self.r, : self.r] = self.start
        seen = y[~np.isnan(y)]
        before = y[:lags][::-1]
        state[self.r :] = np.where(np.isnan(before), seen.mean(), before)
        at = self.r + np.flatnonzero(np.isnan(before))
        cov[at, at] = VAGUE
        added, squares, logs, used, steady = np.outer(self.shock, self.shock), 0.0, 0.0, 0, False
        for value in y[lags:]:
            if np.isnan(value):
                state, cov, steady = self.transition @ state, self.transition @ cov @ self.transition.T + added, False
                continue
            if not steady:
                half = cov @ self.observe
                spread = float(self.observe @ half)
                gain = self.transition @ half / spread
                after = self.transition @ cov @ self.transition.T - np.outer(gain, gain) * spread + added
                steady = bool(np.abs(after - cov).max() < 1e-10)
                cov = after
            error = value - float(self.observe @ state)
            state = self.transition @ state + gain * error
            if spread < VAGUE / 10:
                squares, logs, used = squares + error * error / spread, logs + np.log(spread), used + 1
        variance = max(squares / max(used, 1), TINY)
        return -0.5 * (used * (np.log(2 * np.pi * variance) + 1) + logs), variance, used, state, cov

    def ahead(self, state: np.ndarray, cov: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Forecasts and their variances in units of the shock variance."""
        added, points, spreads = np.outer(self.shock, self.shock), [], []
        for _ in range(steps):
            points.append(float(self.observe @ state))
            spreads.append(float(self.observe @ cov @ self.observe))
            state, cov = self.transition @ state, self.transition @ cov @ self.transition.T + added
        return np.array(points), np.array(spreads)


def minimise(loss, start: np.ndarray, width: float = 0.5, rounds: int = 160, close: float = 1e-7) -> np.ndarray:
    """Nelder-Mead descent: reflect, expand, contract or shrink a simplex."""
    n = len(start)
    corners = np.vstack([start, start + width * np.eye(n)])
    values = np.array([loss(c) for c in corners])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        corners, values = corners[order], values[order]
        if values[-1] - values[0] < close:
            break
        centre = corners[:-1].mean(0)
        mirrored = 2 * centre - corners[-1]
        value = loss(mirrored)
        if value < values[0]:
            further = 3 * centre - 2 * corners[-1]
            beyond = loss(further)
            corners[-1], values[-1] = (further, beyond) if beyond < value else (mirrored, value)
        elif value < values[-2]:
            corners[-1], values[-1] = mirrored, value
        else:
            nearer = (centre + (mirrored if value < values[-1] else corners[-1])) / 2
            inside = loss(nearer)
            if inside < min(value, values[-1]):
                corners[-1], values[-1] = nearer, inside
            else:
                corners[1:] = (corners[1:] + corners[0]) / 2
                values[1:] = [loss(c) for c in corners[1:]]
    return corners[int(np.argmin(values))]


def differences(d: int, seasonal_d: int) -> np.ndarray:
    """Weights of earlier levels in a level whose difference is taken."""
    out = np.array([1.0])
    for lag in [1] * d + [SEASON] * seasonal_d:
        out = np.convolve(out, np.r_[1.0, np.zeros(lag - 1), -1.0])
    return -out[1:]


def fit(y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int], fixed: dict | None = None) -> tuple[Model, int]:
    """Model of largest likelihood for months ``y`` (NaN: missing), and how many coefficients were free.

    ``fixed`` gives coefficients instead: ``ar``, ``ma``, ``seasonal_ar``, ``seasonal_ma``.
    """
    (p, d, q), (sp, sd, sq) = order, seasonal
    weights = differences(d, sd)
    if fixed is not None:
        part = {k: np.asarray(fixed.get(k, ()), float) for k in ("ar", "ma", "seasonal_ar", "seasonal_ma")}
        ar, ma = polynomial(part["ar"], part["seasonal_ar"], -1.0), polynomial(part["ma"], part["seasonal_ma"], 1.0)
        return Model(ar, ma, weights), sum(map(len, part.values()))
    cuts = np.cumsum([p, sp, q])

    def build(free: np.ndarray) -> Model:
        parts = [from_partial(np.tanh(x)) for x in np.split(free, cuts)]
        return Model(polynomial(parts[0], parts[1], -1.0), polynomial(-parts[2], -parts[3], 1.0), weights)

    n = p + sp + q + sq
    if not n:
        return build(np.empty(0)), 0
    found = minimise(lambda free: -build(np.clip(free, -4, 4)).filter(y)[0], np.zeros(n))
    return build(np.clip(found, -4, 4)), n
