"""Window operators over ordered series.

Inputs are aggregated to one row per period first, so a window without a
partition sees as many rows as there are periods, however large the fact is.
Calendar mode frames by month number instead of by row, so gaps are honoured
without adding rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.scalars import as_col, label, month_index, pct_change, safe_div
from scopeledger.operators.joins import checked_join


def _frame(order: str, before: int, after: int, p: Sequence[str], mode: str) -> WindowSpec:
    if mode == "calendar":
        return W.partitionBy(*p).orderBy(month_index(order)).rangeBetween(before, after)
    return W.partitionBy(*p).orderBy(order).rowsBetween(before, after)


def moving_average(
    df: DataFrame,
    value: str,
    order: str,
    before: int,
    after: int = 0,
    strict: bool = False,
    p: Sequence[str] = (),
    mode: str = "rows",
    out: str | None = None,
) -> DataFrame:
    """Mean of the frame; ``strict`` gives NULL until the frame is full."""
    w = _frame(order, -before, after, p, mode)
    n = F.count(value).over(w)
    average = safe_div(F.sum(value).over(w), n)
    if strict:
        average = F.when(n == before + after + 1, average)
    return df.withColumn(out or f"{value}_ma", average)


def period_change(
    df: DataFrame,
    value: str,
    order: str,
    lag: int = 12,
    p: Sequence[str] = (),
    mode: str = "calendar",
    prefix: str = "prior",
) -> DataFrame:
    """Value ``lag`` periods earlier, difference and percent change."""
    if mode == "calendar":
        prior = F.max(value).over(_frame(order, -lag, -lag, p, mode))
    else:
        prior = F.lag(value, lag).over(W.partitionBy(*p).orderBy(order))
    df = df.withColumn(f"{prefix}_{value}", prior)
    return df.withColumn("change", F.col(value) - F.col(f"{prefix}_{value}")).withColumn(
        "pct_change", pct_change(value, f"{prefix}_{value}")
    )


def direction(df: DataFrame, value: str, order: str, p: Sequence[str] = (), out: str = "direction") -> DataFrame:
    """Increasing / Decreasing / Stable against the previous row."""
    previous = F.lag(value).over(W.partitionBy(*p).orderBy(order))
    return df.withColumn("_previous", previous).withColumn(
        out,
        label(
            [(F.col(value) > F.col("_previous"), "Increasing"), (F.col(value) < F.col("_previous"), "Decreasing")],
            "Stable",
        ),
    ).drop("_previous")


def with_index(df: DataFrame, order: str, p: Sequence[str] = (), out: str = "idx") -> DataFrame:
    """0-based position in time."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*p).orderBy(order)) - 1)


def decompose(
    df: DataFrame, value: str, order: str, before: int = 6, after: int = 6, p: Sequence[str] = ()
) -> DataFrame:
    """Additive decomposition: centred trend, month-of-year seasonal, residual, direction."""
    df = moving_average(df, value, order, before, after, p=p, out="trend")
    everything = W.partitionBy(*p)
    by_month = W.partitionBy(*p, F.month(order))
    y = F.col(value).cast("double")
    seasonal = safe_div(F.sum(value).over(by_month), F.count(value).over(by_month))
    overall = safe_div(F.sum(value).over(everything), F.count(value).over(everything))
    df = df.withColumn("seasonal", seasonal - overall).withColumn("detrended", y - F.col("trend"))
    df = df.withColumn("residual", F.col("detrended") - F.col("seasonal"))
    return direction(df, "trend", order, p, out="trend_direction")


def year_ago_of_last(df: DataFrame, value: str, order: str, lag: int = 12, p: Sequence[str] = ()) -> DataFrame:
    """Last row of each series with the value ``lag`` rows before it (NULL when too short)."""
    w = W.partitionBy(*p).orderBy(order)
    tagged = df.withColumn(f"prior_{value}", F.lag(value, lag).over(w)).withColumn(
        "_back", F.row_number().over(W.partitionBy(*p).orderBy(F.col(order).desc()))
    )
    return tagged.filter("_back = 1").drop("_back").withColumn("pct_change", pct_change(value, f"prior_{value}"))


def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "share_pct") -> DataFrame:
    """Percent of the (group) total: aggregate and join back instead of a one-task window."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = checked_join(df, totals, by, "inner") if by else df.crossJoin(F.broadcast(totals))
    return joined.withColumn(out, safe_div(as_col(value).cast("double") * 100, "_total")).drop("_total")
