"""Grouped operators; every aggregate here combines map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.aggregates import distinct_sketch, mean, merged_sketch, scope_sums, sketched_count
from scopeledger.functions.scalars import as_col, pct_change
from scopeledger.operators.joins import checked_join
from scopeledger.operators.windows import with_index


def scope_totals(df: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*scope_sums())


def rollup_report(
    df: DataFrame,
    dims: Sequence[str],
    measures: Sequence[Column],
    total_label: str = "TOTAL",
    all_label: str = "All Types",
) -> DataFrame:
    """Leaf rows, subtotals and grand total of the dimension chain in one scan.

    Levels are told apart by grouping flags, so a NULL dimension value is not
    mistaken for a total. ``level`` is 0 for leaves.
    """
    flags = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    out = df.rollup(*dims).agg(*measures, *flags)
    level = sum((F.col(f"_g_{d}").cast("int") for d in dims), F.lit(0))
    out = out.withColumn("level", level)
    for i, d in enumerate(dims):
        text = total_label if i == 0 else all_label
        out = out.withColumn(d, F.when(F.col(f"_g_{d}") == 1, F.lit(text)).otherwise(F.col(d)))
    return out.drop(*[f"_g_{d}" for d in dims])


def totals_last(df: DataFrame, dims: Sequence[str], total_label: str = "TOTAL", all_label: str = "All Types") -> DataFrame:
    """Order with subtotal rows after their details and the grand total at the end."""
    keys: list[Column] = []
    for i, d in enumerate(dims):
        text = total_label if i == 0 else all_label
        keys += [(F.col(d) == text).cast("int"), F.col(d)]
    return df.orderBy(*keys)


def mean_of_period_sums(df: DataFrame, by: Sequence[str], period: str, cols: Sequence[str]) -> DataFrame:
    """Mean over periods of the sums within each period."""
    sums = df.groupBy(*by, period).agg(*[F.sum(c).alias(c) for c in cols])
    return sums.groupBy(*by).agg(*[mean(c).alias(c) for c in cols])


def first_last(df: DataFrame, value: str, order: str, p: Sequence[str] = ()) -> DataFrame:
    """First and last value of each series, change and percent change."""
    ends = df.groupBy(*p).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value")
    )
    return ends.withColumn("change", F.col("last_value") - F.col("first_value")).withColumn(
        "pct_change", pct_change("last_value", "first_value")
    )


def head_tail(df: DataFrame, aggs: dict[str, str], order: str, n: int = 12, p: Sequence[str] = ()) -> DataFrame:
    """Aggregates of the first and last ``n`` periods side by side; series shorter than n are dropped.

    ``aggs`` maps column to ``sum`` or ``mean``.
    """
    up = F.row_number().over(W.partitionBy(*p).orderBy(order))
    down = F.row_number().over(W.partitionBy(*p).orderBy(F.col(order).desc()))
    tagged = df.withColumn("_up", up).withColumn("_down", down)
    columns: list[Column] = []
    for c, kind in aggs.items():
        fold = F.sum if kind == "sum" else mean
        columns.append(fold(F.when(F.col("_up") <= n, F.col(c))).alias(f"first_{c}"))
        columns.append(fold(F.when(F.col("_down") <= n, F.col(c))).alias(f"last_{c}"))
    return tagged.groupBy(*p).agg(F.count(F.lit(1)).alias("_n"), *columns).filter(F.col("_n") >= n).drop("_n")


def arg_extreme(df: DataFrame, value: str, keep: Sequence[str], which: str = "min", p: Sequence[str] = ()) -> DataFrame:
    """Columns of the row with the smallest or largest value; ties go to the first ``keep`` key."""
    known = df.filter(F.col(value).isNotNull())
    row = F.struct(*keep, value)
    ahead = F.col(value) if which == "min" else -F.col(value)
    best = known.groupBy(*p).agg(F.min_by(row, F.struct(ahead.alias("v"), *keep)).alias("_row"))
    return best.select(*p, "_row.*")


def linear_trend(
    df: DataFrame, y: str, x: str | None = None, order: str | None = None, p: Sequence[str] = ()
) -> DataFrame:
    """Least-squares slope and intercept on ``x``, or on the row index in ``order``."""
    if x is None:
        df, x = with_index(df, order, p, "_x"), "_x"
    yy, xx = as_col(y).cast("double"), as_col(x).cast("double")
    return df.groupBy(*p).agg(
        F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"), F.regr_count(yy, xx).alias("n")
    )


def sigma_band(df: DataFrame, y: str, order: str, n: int = 12, z: float = 1.96, p: Sequence[str] = ()) -> DataFrame:
    """Half width z·σ (population) of the last ``n`` points of each series."""
    back = F.row_number().over(W.partitionBy(*p).orderBy(F.col(order).desc()))
    tail = df.withColumn("_back", back).filter(F.col("_back") <= n)
    return tail.groupBy(*p).agg((F.stddev_pop(as_col(y).cast("double")) * z).alias("half_width"))


def latest_slice(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows of the most recent date; the maximum is a one-row relation."""
    newest = df.agg(F.max(date_col).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).filter(F.col(date_col) == F.col("_newest")).drop("_newest")


def with_group_size(df: DataFrame, by: Sequence[str], out: str = "group_size") -> DataFrame:
    """Attach the size of each row's group: count, then join back (no window over a hot group)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return checked_join(df, sizes, by, "inner")


def composite(cols: Sequence[str]) -> Column:
    """Plain mean of score columns."""
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)


def row_and_distinct_count(key: str, rows: str = "row_count", distinct: str = "distinct_count") -> list[Column]:
    return [F.count(F.lit(1)).alias(rows), F.count_distinct(key).alias(distinct)]


def sketched_by_level(df: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """Estimated distinct ``key`` of every prefix of ``dims`` and in all, from one scan.

    One sketch a leaf is built from the rows; the levels above merge sketches,
    so their cost follows the leaves, not the rows. ``level`` is 0 for leaves.
    """
    leaves = df.groupBy(*dims).agg(distinct_sketch(key).alias("_sketch"), F.count(F.lit(1)).alias("_rows"))
    flags = sum((F.grouping(d).cast("int") for d in dims), F.lit(0))
    return leaves.rollup(*dims).agg(
        F.sum("_rows").alias("row_count"), sketched_count(merged_sketch("_sketch")).alias("estimate"), flags.alias("level")
    )


def metric_agg(aggregate: str, column: str) -> Column:
    """Aggregate named by the metric catalogue."""
    return mean(column) if aggregate == "mean" else F.sum(column)
