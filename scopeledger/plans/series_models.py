"""Per-series model fits used inside grouped tasks. Each takes one short numeric
series (one value per calendar month, NaN where missing) and returns point
forecasts with bounds and what was really fitted."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

from scopeledger.plans import state_space

SEASON = 12
#: Series smoothed at once; their states under all constants fit a core's cache.
TOGETHER = 16


def normal_z(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def holt_winters(y: np.ndarray, steps: int, damped: bool = False, margin: float = 0.1) -> dict:
    """Additive trend and season; all smoothing constants of a grid advance together.

    ``y`` has a place for every calendar month; in a missing one (NaN) the level
    moves on by the trend and nothing is updated.
    """
    return holt_winters_many([y], [steps], damped, margin)[0]


def holt_winters_many(ys: list[np.ndarray], steps: list[int], damped: bool = False, margin: float = 0.1) -> list[dict]:
    """:func:`holt_winters` of many series; those of equal length advance together, ``TOGETHER`` at a time."""
    found: list[dict] = [{}] * len(ys)
    lengths = np.array([len(y) for y in ys])
    for n in np.unique(lengths):
        alike = np.flatnonzero(lengths == n)
        for at in range(0, len(alike), TOGETHER):
            some = alike[at : at + TOGETHER]
            for i, fit in zip(some, _smoothed(np.stack([ys[i] for i in some]), [steps[i] for i in some], damped, margin)):
                found[i] = fit
    return found


def _smoothed(y: np.ndarray, steps: list[int], damped: bool, margin: float) -> list[dict]:
    """Fits of the series in the rows of ``y``."""
    n = y.shape[1]
    alpha, beta, gamma, phi = (
        g.ravel()
        for g in np.meshgrid(
            np.array([0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]),
            np.array([0.0, 0.01, 0.05, 0.1, 0.3]),
            np.array([0.0, 0.05, 0.15, 0.3, 0.6]),
            np.array([0.8, 0.9, 0.98]) if damped else np.array([1.0]),
            indexing="ij",
        )
    )
    starts = [_start(row) for row in y]
    slope = np.array([s for s, _ in starts])[:, None]
    heads = np.stack([h for _, h in starts])
    average = np.array([float(np.nanmean(h)) for h in heads])[:, None]
    ones = np.ones(alpha.shape)
    level, trend = (average - slope) * ones, slope * ones
    season = np.nan_to_num(heads - average).T[:, :, None] * ones
    sse = np.zeros(level.shape)
    keep_level, keep_trend, keep_season = 1 - alpha, 1 - beta, 1 - gamma
    for t in range(n):
        drift, slot, now = phi * trend, t % SEASON, y[:, t, None]
        expected, old = level + drift, season[slot]
        missing = np.isnan(now)
        moved = alpha * (now - old) + keep_level * expected
        turned = beta * (moved - level) + keep_trend * drift
        waved = gamma * (now - moved) + keep_season * old
        error = (now - (expected + old)) ** 2
        if missing.any():
            moved, turned = np.where(missing, expected, moved), np.where(missing, drift, turned)
            waved, error = np.where(missing, old, waved), np.where(missing, 0.0, error)
        sse += error
        level, trend, season[slot] = moved, turned, waved
    fits = []
    for i, best in enumerate(np.argmin(sse, axis=1)):
        h = np.arange(1, steps[i] + 1)
        damping = np.cumsum(phi[best] ** h)
        yhat = level[i, best] + damping * trend[i, best] + season[(n + h - 1) % SEASON, i, best]
        spec = f"additive, alpha {alpha[best]:g}, beta {beta[best]:g}, gamma {gamma[best]:g}, phi {phi[best]:g}"
        fits.append({"yhat": yhat, "lower": yhat * (1 - margin), "upper": yhat * (1 + margin), "spec": spec})
    return fits


def _start(y: np.ndarray) -> tuple[float, np.ndarray]:
    """Slope from months a year apart, and the first known value of each calendar month without it (NaN: none)."""
    apart = y[SEASON : 2 * SEASON] - y[: len(y[SEASON : 2 * SEASON])]
    known = np.flatnonzero(~np.isnan(y))
    if not np.isnan(apart).all():
        slope = float(np.nanmean(apart)) / SEASON
    else:
        slope = (y[known[-1]] - y[known[0]]) / max(known[-1] - known[0], 1)
    head = np.full(SEASON, np.nan)
    for t in known[::-1]:
        head[t % SEASON] = y[t] - slope * t
    return slope, head


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
    return np.hstack([np.sin(angle), np.cos(angle)])


def trend_fourier(
    y: np.ndarray, days: np.ndarray, future_days: np.ndarray, multiplicative: bool = False,
    quarterly: bool = False, level: float = 0.8, changepoints: int = 25,
    trend_scale: float = 0.05, season_scale: float = 10.0,
) -> dict:
    """Piecewise-linear trend plus yearly (and quarterly) waves, by ridge regression."""
    logged = multiplicative and bool((y > 0).all())
    z = np.log(y) if logged else y.astype(float)
    offset, scale = z.mean(), max(float(np.abs(z - z.mean()).max()), 1e-12)
    target = (z - offset) / scale
    origin, span = days[0], max(float(days[-1] - days[0]), 1.0)
    knots = np.linspace(0, 0.8, min(changepoints, max(len(y) - 2, 0)) + 1)[1:]

    def design(d: np.ndarray) -> np.ndarray:
        t = (d - origin) / span
        parts = [np.ones((len(d), 1)), t[:, None], np.maximum(t[:, None] - knots[None, :], 0), _fourier(d, 365.25, 5)]
        if quarterly:
            parts.append(_fourier(d, 91.25, 5))
        return np.hstack(parts)

    x = design(days)
    prior = np.full(x.shape[1], season_scale)
    prior[:2], prior[2 : 2 + len(knots)] = 5.0, trend_scale
    sigma = 0.5
    for _ in range(4):  # noise and coefficients settle together
        weights = np.linalg.solve(x.T @ x / sigma**2 + np.diag(prior**-2.0), x.T @ target / sigma**2)
        sigma = max(float(np.std(target - x @ weights)), 1e-3)
    fit = design(future_days) @ weights * scale + offset
    width = normal_z(level) * sigma * scale
    back = np.exp if logged else (lambda v: v)
    spec = f"{'multiplicative' if logged else 'additive'}, {len(knots)} changepoints, yearly{' and quarterly' if quarterly else ''} waves"
    return {"yhat": back(fit), "lower": back(fit - width), "upper": back(fit + width), "spec": spec}


def sarima(
    y: np.ndarray, steps: int, order: tuple[int, int, int] = (1, 1, 1),
    seasonal_order: tuple[int, int, int] = (1, 1, 1), level: float = 0.95, fixed: dict | None = None,
) -> dict:
    """Seasonal ARIMA of largest likelihood, or with ``fixed`` coefficients; NaN months are missing.

    A series that leaves fewer than two years after differencing gets no
    seasonal part; ``spec`` names the orders really fitted. Criteria compare
    only models of equal differencing.
    """
    y = y.astype(float)
    (p, d, q), (sp, sd, sq) = order, seasonal_order
    if fixed is None and int((~np.isnan(y)).sum()) - d - SEASON * sd < 2 * SEASON:
        sp = sd = sq = 0
    mean = float(np.nanmean(y)) if d + sd == 0 else 0.0
    scale = max(float(np.nanstd(y)), 1e-9)
    model, free = state_space.fit((y - mean) / scale, (p, d, q), (sp, sd, sq), fixed)
    loglik, variance, n, state, cov = model.filter((y - mean) / scale)
    points, spreads = model.ahead(state, cov, steps)
    yhat = points * scale + mean
    width = normal_z(level) * np.sqrt(variance * np.maximum(spreads, 0.0)) * scale
    loglik, k = loglik - n * np.log(scale), free + 1
    return {
        "yhat": yhat, "lower": yhat - width, "upper": yhat + width, "aic": 2 * k - 2 * loglik,
        "bic": k * np.log(max(n, 1)) - 2 * loglik, "loglik": loglik, "spec": f"({p},{d},{q})({sp},{sd},{sq},{SEASON})",
    }
