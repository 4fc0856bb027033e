"""Aggregate column expressions: all have partial (map-side) forms in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scopeledger.functions.scalars import as_col, safe_div, total_emissions


def mean(c: str | Column) -> Column:
    """Average over non-NULL values; exact for DECIMAL input, NULL for none."""
    return safe_div(F.sum(as_col(c)), F.count(as_col(c)))


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds; NULL counts as no."""
    return F.count_if(condition)


def ratio_of_sums(num: str | Column, den: str | Column) -> Column:
    return safe_div(F.sum(as_col(num)), F.sum(as_col(den)))


def mean_of_ratios(num: str | Column, den: str | Column) -> Column:
    return F.avg(safe_div(num, den))


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    return safe_div(F.sum(as_col(x) * as_col(w)), F.sum(as_col(w)))


def scope_sums(s1: str = "scope1", s2: str = "scope2", s3: str = "scope3", total: str = "total") -> list[Column]:
    return [
        F.sum("scope1_tonnes").alias(s1),
        F.sum("scope2_market_tonnes").alias(s2),
        F.sum("scope3_tonnes").alias(s3),
        F.sum(total_emissions()).alias(total),
    ]


#: Registers of a distinct sketch as a power of two.
SKETCH_BITS = 12
#: Three standard errors of a sketch's estimate.
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketch(c: str | Column) -> Column:
    """Mergeable sketch of the distinct non-NULL values."""
    return F.hll_sketch_agg(as_col(c), F.lit(SKETCH_BITS))


def merged_sketch(c: str | Column) -> Column:
    return F.hll_union_agg(as_col(c))


def sketched_count(c: str | Column) -> Column:
    """Estimated distinct values, within :data:`SKETCH_ERROR` of the count in all but a few of a thousand cases."""
    return F.hll_sketch_estimate(as_col(c))
