"""Monthly forecasting, one model per series, all series in parallel.

Series are aggregated to one row per month before grouping, so a group holds as
many rows as the calendar has months no matter how many readings a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopeledger.functions.scalars import label, named_band, pct_change, safe_div
from scopeledger.model import lookups as L
from scopeledger.operators.aggregates import linear_trend, sigma_band
from scopeledger.operators.calendar import future_months, resample_monthly
from scopeledger.operators.joins import literal_dim, null_safe_join, scenario_grid
from scopeledger.operators.windows import with_index, year_ago_of_last
from scopeledger.plans import series_models as models

MIN_POINTS = 12
#: Series whose forecasts are made and sent at once.
AT_ONCE = 512


def metric_catalogue(spark: SparkSession) -> DataFrame:
    return literal_dim(spark, L.METRIC_ROWS, L.METRIC_SCHEMA)


def scenarios(spark: SparkSession) -> DataFrame:
    return literal_dim(spark, L.SCENARIO_ROWS, L.SCENARIO_SCHEMA)


def metric_kind(metric: str) -> str:
    return next(row[3] for row in L.METRIC_ROWS if row[2] == metric)


def _keyed(left: DataFrame, right: DataFrame, p: Sequence[str], how: str = "inner") -> DataFrame:
    return null_safe_join(left, right, p, how) if p else left.crossJoin(F.broadcast(right))


def prepare_series(df: DataFrame, metric: str, p: Sequence[str] = (), min_points: int = MIN_POINTS) -> DataFrame:
    """Monthly series ``(p, date, y)`` with the metric's own aggregate.

    Series of fewer than ``min_points`` months are left out; :func:`series_coverage` lists them.
    """
    monthly = resample_monthly(df, "date", {"y": (metric_kind(metric), metric)}, p)
    counted = monthly.dropna(subset=["y"]).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*p)))
    return counted.filter(F.col("_n") >= min_points).drop("_n")


def series_coverage(
    df: DataFrame, metric: str, p: Sequence[str] = (), min_points: int = MIN_POINTS, test_size: int = 6
) -> DataFrame:
    """What becomes of every series: its known, spanned and missing months, and ``status``.

    ``too_short``: :func:`prepare_series` leaves it out; ``not_fitted``: it has
    too few months beside the test ones; ``without_season``: seasonal ARIMA
    drops its seasonal orders; ``fitted``: nothing is left out.
    """
    monthly = resample_monthly(df, "date", {"y": (metric_kind(metric), metric)}, p)
    known, train = F.count("y"), F.col("points") - test_size
    found = monthly.groupBy(*p).agg(known.alias("points"), F.count(F.lit(1)).alias("months"), F.min("date").alias("first"), F.max("date").alias("last"))
    status = F.when(F.col("points") < min_points, "too_short").when(train < MIN_POINTS, "not_fitted")
    return found.select(
        *p, "points", "months", (F.col("months") - F.col("points")).alias("missing"), "first", "last",
        status.when(train - 13 < 2 * models.SEASON, "without_season").otherwise("fitted").alias("status"),
    )


def split_tail(df: DataFrame, k: int = 6, p: Sequence[str] = ()) -> DataFrame:
    """Mark the last ``k`` months of each series as test rows."""
    back = F.row_number().over(W.partitionBy(*p).orderBy(F.col("date").desc()))
    return df.withColumn("is_test", back <= k)


# -- models ---------------------------------------------------------------------


FORECAST_FIELDS = [
    T.StructField("date", T.DateType()), T.StructField("step", T.IntegerType()),
    T.StructField("is_future", T.BooleanType()), T.StructField("y", T.DoubleType()),
    T.StructField("yhat", T.DoubleType()), T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()), T.StructField("aic", T.DoubleType()),
    T.StructField("bic", T.DoubleType()), T.StructField("loglik", T.DoubleType()), T.StructField("spec", T.StringType()),
]


def _fits(model: str, params: dict, series: list[dict]) -> list[dict]:
    """Forecasts of every series, at its ``places`` of the months after training."""
    if model == "holt_winters":
        return models.holt_winters_many([s["y"] for s in series], [s["steps"] for s in series], **params)
    if model == "trend_fourier":
        return [models.trend_fourier(s["y"][s["known"]], s["days"], s["future"], **params) for s in series]
    if model == "sarima":
        return [models.sarima(s["y"], s["steps"], **params) for s in series]
    raise ValueError(f"unknown model {model}")


def _laid_out(days: np.ndarray, y: np.ndarray, horizon: int, test_size: int) -> dict:
    """A series on its calendar: places without a row are missing, and a forecast steps over them."""
    months = days.astype("datetime64[D]").astype("datetime64[M]")
    slots = (months - months[0]).astype(int)
    train = len(days) - test_size
    known = slots[:train]
    whole = np.full(known[-1] + 1, np.nan)
    whole[known] = y[:train]
    ahead = months[-1] + 1 + np.arange(horizon)
    wanted = np.r_[slots[train:], slots[-1] + 1 + np.arange(horizon)]
    return {
        "y": whole, "known": known, "steps": int(slots[-1] - known[-1]) + horizon, "places": wanted - known[-1] - 1,
        "days": days[:train].astype(float), "future": np.r_[days[train:], ahead.astype("datetime64[D]").astype(int)].astype(float),
        "ends": (np.r_[months[train:], ahead] + 1).astype("datetime64[D]") - 1,
        "step": wanted - slots[-1] - 1, "tested": np.r_[y[train:], np.full(horizon, np.nan)],
    }


def _forecasts(keys: list[str], model: str, horizon: int, params: dict, test_size: int):
    """Forecast rows of batches whose last column holds the months of a series, in order."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                months = part.column(part.num_columns - 1)
                flat, ends = months.flatten(), np.cumsum(months.value_lengths().to_numpy())[:-1]
                days = np.split(flat.field(0).cast(pa.int32()).to_numpy().astype(int), ends)
                values = np.split(flat.field(1).to_numpy(zero_copy_only=False).astype(float), ends)
                series = [_laid_out(d, y, horizon, test_size) for d, y in zip(days, values)]
                fits = _fits(model, params, series)
                sizes = [len(s["step"]) for s in series]
                of = pa.array(np.repeat(np.arange(len(series)), sizes))
                step = np.concatenate([s["step"] for s in series]).astype("int32")
                # the waves are fitted at the wanted days alone
                places = [slice(None) if model == "trend_fourier" else s["places"] for s in series]
                columns = [part.column(i).take(of) for i in range(len(keys))]
                columns += [pa.array(np.concatenate([s["ends"] for s in series])), pa.array(step), pa.array(step >= 0)]
                columns.append(pa.array(np.concatenate([s["tested"] for s in series]), from_pandas=True))
                for name in ("yhat", "lower", "upper"):
                    columns.append(pa.array(np.concatenate([fit[name][p] for fit, p in zip(fits, places)]), from_pandas=True))
                for name, kind in (("aic", pa.float64()), ("bic", pa.float64()), ("loglik", pa.float64()), ("spec", pa.string())):
                    columns.append(pa.array([fit.get(name) for fit in fits], kind, from_pandas=True).take(of))
                yield pa.RecordBatch.from_arrays(columns, [*keys, *[f.name for f in FORECAST_FIELDS]])

    return run


def fit_forecast(
    df: DataFrame, model: str, horizon: int = 24, params: dict | None = None, p: Sequence[str] = (), test_size: int = 6
) -> DataFrame:
    """Forecast every series: test months (step < 0, with y) and ``horizon`` future months.

    Months without a row are missing, not closed up. Series whose training part
    has fewer than twelve months are left out; :func:`series_coverage` lists
    them. Models: ``holt_winters`` (damped), ``trend_fourier`` (multiplicative,
    quarterly, level), ``sarima`` (order, seasonal_order, level). ``spec`` says
    what was really fitted: short series get no seasonal orders, and series with
    values of zero or less no multiplicative waves.
    """
    keys = list(p) or ["series"]
    # Fits are slow for their size in bytes, so adaptive merging would leave them to a few tasks.
    # A partition count of its own keeps this exchange, smaller tasks balance better, and the
    # series are put together in place.
    tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = df if p else df.withColumn("series", F.lit("all"))
    spread = series.select(*keys, "date", F.col("y").cast("double").alias("y")).repartition(tasks, *keys)
    months = F.sort_array(F.collect_list(F.struct(F.col("date").cast("date").alias("date"), "y")))
    whole = spread.groupBy(*keys).agg(months.alias("_months")).filter(F.size("_months") >= MIN_POINTS + test_size)
    schema = T.StructType([whole.schema[k] for k in keys] + FORECAST_FIELDS)
    return whole.mapInArrow(_forecasts(keys, model, horizon, params or {}, test_size), schema)


def extend_trend(series: DataFrame, horizon: int, p: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """The fitted straight line carried on ``horizon`` months, with a ±z·σ(last 12) band.

    Needs no Python workers; also the reference forecast of the scenario reports.
    """
    fit = linear_trend(series, "y", order="date", p=p)
    fit = _keyed(fit, sigma_band(series, "y", "date", 12, z, p), p)
    ahead = future_months(series, "date", horizon, p)
    joined = _keyed(ahead, fit, p)
    yhat = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step"))
    return joined.select(
        *p, "date", "step", yhat.alias("yhat"), (yhat - F.col("half_width")).alias("lower"),
        (yhat + F.col("half_width")).alias("upper"),
    )


def naive_band(forecast: DataFrame, history: DataFrame, p: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """Replace the bounds by yhat ± z·σ of the last twelve observations."""
    joined = _keyed(forecast.drop("lower", "upper"), sigma_band(history, "y", "date", 12, z, p), p)
    return joined.withColumns({
        "lower": F.col("yhat") - F.col("half_width"), "upper": F.col("yhat") + F.col("half_width"),
    }).drop("half_width")


def trend_test_predictions(series: DataFrame, k: int = 6, p: Sequence[str] = ()) -> DataFrame:
    """Test months predicted by the straight line fitted to the training months."""
    split = with_index(split_tail(series, k, p), "date", p)
    fit = linear_trend(split.filter(~F.col("is_test")), "y", "idx", p=p)
    tested = _keyed(split.filter("is_test"), fit, p)
    return tested.select(*p, "date", "y", (F.col("intercept") + F.col("slope") * F.col("idx")).alias("yhat"))


def accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat", p: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE (%) and its band over the rows that have both values."""
    error = F.col(y).cast("double") - F.col(yhat)
    scored = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*p).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(safe_div(error, y))) * 100).alias("mape"),
    )
    return scored.withColumn("accuracy_band", named_band("mape", "mape"))


# -- scenarios --------------------------------------------------------------------


def schedule(i: Column, n: Column, end: Column) -> Column:
    """Evenly spaced from 1 at i = 0 to ``end`` at i = n - 1; 1 when n is 1."""
    return F.when(n > 1, 1 + (end - 1) * i / (n - 1)).otherwise(1.0)


def apply_scenarios(
    future: DataFrame, scenario_rows: DataFrame, metric: str, p: Sequence[str] = (), current: DataFrame | None = None
) -> DataFrame:
    """Every future month under every scenario, always starting from business as usual.

    Emission metrics scale value and bounds; ``pue`` falls a fixed step a month;
    ``cfe_pct`` ramps from ``current`` (one row per series, column y) to 1.
    """
    n = F.max("step").over(W.partitionBy(*p)) - F.min("step").over(W.partitionBy(*p)) + 1
    i = F.col("step") - F.min("step").over(W.partitionBy(*p))
    rows = scenario_grid(future.withColumns({"_n": n, "_i": i}), scenario_rows)
    yhat, lower, upper = F.col("yhat"), F.col("lower"), F.col("upper")
    if metric == "pue":
        yhat = yhat - F.col("_i") * F.col("pue_step")
    elif metric == "cfe_pct":
        if current is None:
            raise ValueError("cfe_pct scenarios need the current value of each series")
        rows = _keyed(rows, current.withColumnRenamed("y", "_now"), p)
        now = F.col("_now").cast("double")
        per_month = (1 - now) / F.least(F.lit(L.CFE_RAMP_MONTHS), F.col("_n"))
        yhat = F.when(F.col("cfe_ramp"), F.least(F.lit(1.0), now + F.col("_i") * per_month)).otherwise(yhat)
    else:
        factor = schedule(F.col("_i"), F.col("_n"), F.col("end_factor"))
        yhat, lower, upper = yhat * factor, lower * factor, upper * factor
    return rows.select(
        *p, "scenario", "date", "step", yhat.alias("yhat"), lower.alias("lower"), upper.alias("upper")
    )


def compare_scenarios(adjusted: DataFrame, p: Sequence[str] = ()) -> DataFrame:
    """Cumulative total of each scenario and its reduction against business as usual."""
    totals = adjusted.groupBy(*p, "scenario").agg(F.sum("yhat").alias("total"))
    bau = totals.filter(F.col("scenario") == L.SCENARIO_ROWS[0][0]).select(*p, F.col("total").alias("_bau"))
    joined = _keyed(totals, bau, p)
    return joined.select(
        *p, "scenario", "total", (F.col("_bau") - F.col("total")).alias("reduction"),
        (safe_div(F.col("_bau") - F.col("total"), "_bau") * 100).alias("reduction_pct"),
    )


def target_lines(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """Monthly target of each metric (share of the yearly one) and its operational reference line."""
    metrics = metric_catalogue(spark)
    goals = targets.select(F.col("scope").alias("target_scope"), "target_year", "target_emissions")
    joined = metrics.join(F.broadcast(goals), "target_scope", "left")
    return joined.select(
        "target", "metric", "target_year",
        (F.col("target_emissions") * F.col("target_share") / 12).alias("monthly_target"), "reference_line",
    )


def series_kpis(series: DataFrame, p: Sequence[str] = ()) -> DataFrame:
    """Current value, mean, change on the 13th value from the end, and trend sign."""
    last = year_ago_of_last(series, "y", "date", 12, p).select(
        *p, F.col("y").alias("current_value"), F.col("pct_change").alias("yoy_pct")
    )
    means = series.groupBy(*p).agg(safe_div(F.sum("y"), F.count("y")).alias("mean_value"))
    trend = linear_trend(series, "y", order="date", p=p).select(
        *p, label([(F.col("slope") > 0, "Increasing")], "Decreasing").alias("trend")
    )
    return _keyed(_keyed(last, means, p), trend, p)


def forecast_summary(history: DataFrame, future: DataFrame, p: Sequence[str] = ()) -> DataFrame:
    """End value against today, band width in percent, and their bands."""
    now = history.groupBy(*p).agg(F.max_by("y", "date").cast("double").alias("current_value"))
    ahead = future.groupBy(*p).agg(
        F.max_by("yhat", "date").alias("end_value"),
        (safe_div(F.avg(F.col("upper") - F.col("lower")), F.avg("yhat")) * 100).alias("uncertainty_pct"),
    )
    out = _keyed(now, ahead, p)
    change = F.coalesce(pct_change("end_value", "current_value"), F.lit(0.0))
    return out.withColumns({
        "change": F.col("end_value") - F.col("current_value"), "change_pct": change,
        "confidence": named_band("uncertainty_pct", "uncertainty"),
        "outlook": named_band(change, "forecast_change"),
    })

