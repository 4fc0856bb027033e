"""Seasonal smoothing and ridge regression as column expressions, without Python workers.

A series becomes one row with its months as an ordered array, in which missing
months are NULL; the calendar bounds its length. Smoothing is a fold over that
array. Regression sums the products of its columns, which combine map-side, and
solves each series' normal equations by Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.functions.scalars import month_index
from scopeledger.operators.joins import null_safe_join, scenario_grid

SEASON = 12
CONSTANTS = ("alpha", "beta", "gamma", "phi")


def month_arrays(series: DataFrame, p: Sequence[str] = (), y: str = "y") -> DataFrame:
    """``p, first, n, y``: every calendar month from a series' first to its last; months without a row are NULL."""
    months = F.map_from_entries(F.collect_list(F.struct(month_index("date").alias("k"), F.col(y).cast("double").alias("v"))))
    found = series.groupBy(*p).agg(
        F.min(month_index("date")).alias("_lo"), F.max(month_index("date")).alias("_hi"), F.min("date").alias("first"), months.alias("_y")
    ).where(F.col("_lo").isNotNull())
    return found.select(
        *p, "first", (F.col("_hi") - F.col("_lo") + 1).alias("n"),
        F.transform(F.sequence("_lo", "_hi"), lambda k: F.try_element_at("_y", k)).alias("y"),
    )


def _mean(values: Column) -> Column:
    known = F.filter(values, lambda v: v.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))


def _with_start(arrays: DataFrame) -> DataFrame:
    """Slope from months a year apart, then the first known value of each calendar month without it."""
    y, slots = F.col("y"), F.sequence(F.lit(0), F.lit(SEASON - 1))
    apart = F.transform(slots, lambda i: F.get(y, i + SEASON) - F.get(y, i))
    known = F.filter(F.transform(y, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["v"].isNotNull())
    ends = arrays.withColumn("_known", known).withColumns({"_a": F.get("_known", F.lit(0)), "_b": F.element_at("_known", -1)})
    whole = (F.col("_b.v") - F.col("_a.v")) / F.greatest(F.col("_b.i") - F.col("_a.i"), F.lit(1))
    sloped = ends.withColumn("_slope", F.coalesce(_mean(apart) / SEASON, whole))
    years = F.sequence(F.lit(0), F.floor(F.col("n") / SEASON).cast("int"))

    def first_known(s: Column) -> Column:
        at = lambda k: s + k * SEASON
        return F.aggregate(years, F.lit(None).cast("double"), lambda a, k: F.coalesce(a, F.get(y, at(k)) - F.col("_slope") * at(k)))

    heads = sloped.withColumn("_heads", F.transform(slots, first_known)).withColumn("_level", _mean(F.col("_heads")))
    season = F.transform("_heads", lambda h: F.coalesce(h - F.col("_level"), F.lit(0.0)))
    return heads.withColumn("start", F.struct(
        (F.col("_level") - F.col("_slope")).alias("level"), F.col("_slope").alias("trend"), season.alias("season"), F.lit(0.0).alias("sse"),
    )).drop("_known", "_a", "_b", "_slope", "_heads", "_level")


def _advance(alpha: Column, beta: Column, gamma: Column, phi: Column):
    def step(state: Column, month: Column) -> Column:
        value, slot = month["v"], month["i"] % SEASON
        drift, season = phi * state["trend"], F.get(state["season"], slot)
        expected = state["level"] + drift
        level = F.coalesce(alpha * (value - season) + (1 - alpha) * expected, expected)
        trend = F.when(value.isNull(), drift).otherwise(beta * (level - state["level"]) + (1 - beta) * drift)
        turned = F.transform(state["season"], lambda s, j: F.when(j == slot, F.coalesce(gamma * (value - level) + (1 - gamma) * s, s)).otherwise(s))
        error = F.coalesce(value - expected - season, F.lit(0.0))
        return F.struct(level.alias("level"), trend.alias("trend"), turned.alias("season"), (state["sse"] + error * error).alias("sse"))

    return step


def smooth(series: DataFrame, constants: DataFrame, p: Sequence[str] = ()) -> DataFrame:
    """State of every series after its last month under every row of ``constants`` (alpha, beta, gamma, phi), and its ``sse``.

    Additive trend and season. A missing month moves the level on by the trend
    and updates nothing.
    """
    rows = scenario_grid(_with_start(month_arrays(series, p)), constants)
    months = F.transform("y", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    state = F.aggregate(months, F.col("start"), _advance(*[F.col(c) for c in CONSTANTS]))
    return rows.withColumn("_s", state).select(*p, "first", "n", *CONSTANTS, "_s.level", "_s.trend", "_s.season", "_s.sse")


def best_constants(states: DataFrame, p: Sequence[str] = ()) -> DataFrame:
    """The state of least squared error of each series; ties go to the smallest constants."""
    rest = [c for c in states.columns if c not in p]
    best = F.min_by(F.struct(*rest), F.struct("sse", *CONSTANTS)).alias("_best")
    return states.groupBy(*p).agg(best).select(*p, "_best.*")


def smoothed_forecast(states: DataFrame, horizon: int, p: Sequence[str] = (), margin: float = 0.1) -> DataFrame:
    """``horizon`` month-end forecasts of every state, with bounds of ±``margin``."""
    ahead = states.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    damping = F.when(F.col("phi") == 1, F.col("h").cast("double")).otherwise(F.col("phi") * (1 - F.pow("phi", "h")) / (1 - F.col("phi")))
    season = F.get("season", ((F.col("n") + F.col("h") - 1) % SEASON).cast("int"))
    yhat = F.col("level") + damping * F.col("trend") + season
    dated = ahead.withColumn("yhat", yhat).withColumn("date", F.last_day(F.add_months("first", (F.col("n") + F.col("h") - 1).cast("int"))))
    return dated.select(
        *p, "date", (F.col("h") - 1).alias("step"), "yhat", (F.col("yhat") * (1 - margin)).alias("lower"),
        (F.col("yhat") * (1 + margin)).alias("upper"),
    )


# -- regression -------------------------------------------------------------------


def wave_features(df: DataFrame, date: str = "date", period: float = 365.25, order: int = 2) -> DataFrame:
    """Add ``sin1, cos1, ...`` of the day at the given period, in days since 1970."""
    angle = F.unix_date(date) * F.lit(6.283185307179586) / F.lit(period)
    waves = {}
    for k in range(1, order + 1):
        waves |= {f"sin{k}": F.sin(angle * k), f"cos{k}": F.cos(angle * k)}
    return df.withColumns(waves)


def gram(df: DataFrame, y: str, xs: Sequence[str], p: Sequence[str] = ()) -> DataFrame:
    """Sums of products ``g_i_j`` (j <= i) and ``h_i`` with ``y``, in one shuffle; rows with a NULL are left out."""
    known = df.dropna(subset=[y, *xs])
    products = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs[: i + 1])]
    return known.groupBy(*p).agg(F.count(F.lit(1)).alias("n"), *products, *[F.sum(F.col(a).cast("double") * F.col(y)).alias(f"h_{i}") for i, a in enumerate(xs)])


def ridge(df: DataFrame, y: str, xs: Sequence[str], penalties: Sequence[float], p: Sequence[str] = ()) -> DataFrame:
    """Coefficients ``b_<x>`` of each series that minimise squared error plus penalised squares.

    A series whose columns are linearly dependent and unpenalised has NULL coefficients.
    """
    k, out = len(xs), gram(df, y, xs, p)
    positive = lambda c: F.when(c > 1e-12, F.sqrt(c))
    for i in range(k):  # factor row by row; each row is a projection of its own
        row = {}
        for j in range(i):
            done = sum((row[m] * F.col(f"l_{j}_{m}") for m in range(j)), F.lit(0.0))
            row[j] = (F.col(f"g_{i}_{j}") - done) / F.col(f"l_{j}_{j}")
        out = out.withColumns({f"l_{i}_{j}": c for j, c in row.items()}) if row else out
        squares = sum((F.col(f"l_{i}_{m}") * F.col(f"l_{i}_{m}") for m in range(i)), F.lit(0.0))
        out = out.withColumn(f"l_{i}_{i}", positive(F.col(f"g_{i}_{i}") + F.lit(float(penalties[i])) - squares))
    for i in range(k):
        done = sum((F.col(f"l_{i}_{m}") * F.col(f"z_{m}") for m in range(i)), F.lit(0.0))
        out = out.withColumn(f"z_{i}", (F.col(f"h_{i}") - done) / F.col(f"l_{i}_{i}"))
    for i in reversed(range(k)):
        done = sum((F.col(f"l_{m}_{i}") * F.col(f"b_{xs[m]}") for m in range(i + 1, k)), F.lit(0.0))
        out = out.withColumn(f"b_{xs[i]}", (F.col(f"z_{i}") - done) / F.col(f"l_{i}_{i}"))
    return out.select(*p, "n", *[f"b_{x}" for x in xs])


def predict(df: DataFrame, fitted: DataFrame, xs: Sequence[str], p: Sequence[str] = (), out: str = "yhat") -> DataFrame:
    """Fitted values of the rows of ``df``; series without a fit keep NULL."""
    coefficients = fitted.select(*p, *[f"b_{x}" for x in xs])
    joined = null_safe_join(df, coefficients, p, "left") if p else df.crossJoin(F.broadcast(coefficients))
    value = sum((F.col(f"b_{x}") * F.col(x) for x in xs[1:]), F.col(f"b_{xs[0]}") * F.col(xs[0]))
    return joined.withColumn(out, value).drop(*[f"b_{x}" for x in xs])
