"""Joins. Dimensions carry no broadcast hint: Spark compares their size with
``spark.sql.autoBroadcastJoinThreshold`` (and again at run time) and sorts and
merges beyond it. Only relations of a fixed row count are hinted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopeledger.functions.scalars import as_col, shift_year
from scopeledger.session import settle

#: Rows up to which :func:`checked_join` broadcasts its counted side.
BROADCAST_ROWS = 100_000


def enrich(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    return fact.join(dim, on if isinstance(on, str) else list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys, as they do in GROUP BY."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


def checked_join(
    fact: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join raw rows to an aggregated relation that is usually small.

    The side is settled and counted; up to ``max_rows`` it is broadcast, so a hot
    key costs no shuffle. Beyond that it is a sort-merge join whose oversized
    partitions Spark splits at run time.
    """
    side = settle(side)
    if side.count() <= max_rows:
        side = F.broadcast(side)
    return null_safe_join(fact, side, on, how)


def literal_dim(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Small fixed table from rows written in the program."""
    return spark.createDataFrame(list(rows), schema)


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default: object) -> DataFrame:
    """Add ``value`` from a fixed lookup table, with a default for unknown keys."""
    joined = df.join(F.broadcast(dim.select(on, value)), on, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def with_constant_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row relation to every row; no rows when it is empty."""
    return df.crossJoin(F.broadcast(one_row))


def scenario_grid(df: DataFrame, *grids: DataFrame) -> DataFrame:
    """Every row under every combination of the (fixed-size) parameter tables."""
    for grid in grids:
        df = df.crossJoin(F.broadcast(grid))
    return df


def number_grid(spark: SparkSession, name: str, start: float, stop: float, points: int) -> DataFrame:
    """``points`` evenly spaced values from start to stop, inclusive."""
    step = (stop - start) / (points - 1) if points > 1 else 0.0
    return spark.range(points).select((F.lit(start) + F.col("id") * F.lit(step)).alias(name))


def allocate_by_share(total_df: DataFrame, total: str, dim: DataFrame, share: Column, out: str) -> DataFrame:
    """Spread totals over a fixed dimension; aggregate first, then cross join."""
    return scenario_grid(total_df, dim).withColumn(out, as_col(total).cast("double") * share)


def same_period_last_year(df: DataFrame, date_col: str, value: str, p: Sequence[str] = ()) -> DataFrame:
    """Pair each period with the one a year earlier; periods without one are dropped."""
    prior = df.select(*p, shift_year(date_col, 1).alias(date_col), F.col(value).alias(f"prior_{value}"))
    return df.join(prior, [*p, date_col])


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of the fact that the dimension lacks, with their row counts.

    Counting before the anti join shuffles one row per key, however hot it is.
    """
    return fact.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(dim.select(key), key, "left_anti")
