"""Row selection: dimension filters, required columns, value domains."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.functions.scalars import date_literal

#: Longest value list still written as an IN predicate (it reaches the Parquet scan).
INLINE_VALUES = 200


def year_range(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Keep whole years as a date range; also by ``year`` when the table is partitioned by it."""
    if first is not None:
        df = df.filter(F.col("date") >= date_literal(date(first, 1, 1)))
        if "year" in df.columns:
            df = df.filter(F.col("year") >= first)
    if last is not None:
        df = df.filter(F.col("date") < date_literal(date(last + 1, 1, 1)))
        if "year" in df.columns:
            df = df.filter(F.col("year") <= last)
    return df


def in_year(df: DataFrame, year: int) -> DataFrame:
    return year_range(df, year, year)


def keep_values(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """IN-list; an empty or absent list keeps everything, a long one is a semi join."""
    if not values:
        return df
    if len(values) <= INLINE_VALUES:
        return df.filter(F.col(column).isin(list(values)))
    wanted = df.sparkSession.createDataFrame(
        [(v,) for v in dict.fromkeys(values)], df.select(column).schema
    )
    # a join on a named key would move it to the front
    return df.join(wanted, df[column] == wanted[column], "left_semi")


def apply_filters(
    df: DataFrame,
    facilities: Sequence | None = None,
    regions: Sequence | None = None,
    types: Sequence | None = None,
    years: Sequence[int] | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """All dashboard filters in one predicate chain; bounds are inclusive."""
    if start is not None:
        df = df.filter(F.col("date") >= date_literal(start))
    if end is not None:
        df = df.filter(F.col("date") <= date_literal(end))
    if years:
        df = year_range(df, min(years), max(years)).filter(F.year("date").isin(list(years)))
    df = keep_values(df, "facility_id", facilities)
    df = keep_values(df, "region", regions)
    return keep_values(df, "facility_type", types)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(column).distinct().orderBy(column)
