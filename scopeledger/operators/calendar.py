"""Month spines, gap filling and monthly resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.aggregates import mean
from scopeledger.functions.scalars import date_literal, month_start


def months_between(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("interval 1 month"))


def month_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First-of-month dates from the month of ``start`` to the month of ``end``."""
    lo, hi = F.trunc(date_literal(start), "month"), F.trunc(date_literal(end), "month")
    return spark.range(1).select(F.explode(months_between(lo, hi)).alias("date"))


def fill_months(monthly: DataFrame, date_col: str = "date", p: Sequence[str] = (), zero: Sequence[str] = ()) -> DataFrame:
    """Insert the missing months of each series between its first and last.

    Each row explodes into itself plus the gap up to its successor, so no spine
    join is needed. Columns in ``zero`` become 0 in new rows, others NULL.
    """
    order = W.partitionBy(*p).orderBy(date_col)
    current = F.col(date_col)
    until = F.coalesce(F.add_months(F.lead(current).over(order), -1), current)
    slots = monthly.withColumn("_until", until).withColumn(
        "_slot", F.explode(months_between(current, F.col("_until")))
    )
    observed = F.col("_slot") == current
    out = [F.col(c) for c in p] + [F.col("_slot").alias(date_col)]
    for c in monthly.columns:
        if c in p or c == date_col:
            continue
        kept = F.when(observed, F.col(c))
        out.append((F.coalesce(kept.otherwise(F.lit(0)), F.lit(0)) if c in zero else kept).alias(c))
    return slots.select(*out)


def resample_monthly(
    df: DataFrame,
    date_col: str,
    aggs: dict[str, tuple[str, str]],
    p: Sequence[str] = (),
    fill_sum: float | None = 0,
) -> DataFrame:
    """One row per calendar month and series; empty months sum to 0 and average to NULL.

    ``aggs`` maps output name to (``sum`` | ``mean``, source column).
    """
    columns = [(F.sum(src) if kind == "sum" else mean(src)).alias(out) for out, (kind, src) in aggs.items()]
    monthly = df.groupBy(*p, month_start(date_col).alias(date_col)).agg(*columns)
    zero = [out for out, (kind, _) in aggs.items() if kind == "sum" and fill_sum is not None]
    return fill_months(monthly, date_col, p, zero)


def missing_months(df: DataFrame, date_col: str = "date", p: Sequence[str] = ()) -> DataFrame:
    """Months without any row between the first and last month of each series."""
    present = df.select(*p, month_start(date_col).alias(date_col)).distinct().withColumn("_seen", F.lit(True))
    return fill_months(present, date_col, p).filter(F.col("_seen").isNull()).drop("_seen")


def future_months(df: DataFrame, date_col: str, horizon: int, p: Sequence[str] = ()) -> DataFrame:
    """``horizon`` month-end dates after the last month of each series."""
    last = df.groupBy(*p).agg(F.max(month_start(date_col)).alias("_last"))
    span = months_between(F.add_months("_last", 1), F.add_months("_last", horizon))
    return last.select(*p, F.posexplode(span).alias("step", "_m")).select(
        *p, "step", F.last_day("_m").alias(date_col)
    )
