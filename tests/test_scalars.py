from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from scopeledger.functions import aggregates as Ag
from scopeledger.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_is_half_up(spark):
    assert value(spark, S.round_half_up(F.lit(2.5))) == 3
    assert value(spark, S.round_half_up(F.lit(-2.5))) == -3
    assert value(spark, S.round_half_up(F.lit(2.675), 2)) == 2.68


def test_rounded_ratio_ignores_binary_noise(spark):
    assert value(spark, S.round_ratio(F.lit(1125266.325), F.lit(5), 2)) == 225053.27
    assert value(spark, S.round_ratio(F.lit(1.0), F.lit(0), 2)) is None


@pytest.mark.parametrize("a,b,want", [(6, 3, 2.0), (6, 0, None), (None, 3, None), (6, None, None)])
def test_safe_div(spark, a, b, want):
    lit = lambda x: F.lit(x).cast("double")
    assert value(spark, S.safe_div(lit(a), lit(b))) == want


def test_finite_drops_nan_and_infinity(spark):
    rows = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x DOUBLE")
    assert [r["v"] for r in rows.select(S.finite("x").alias("v")).collect()] == [1.0, None, None, None, None]


def test_clamp_keeps_null(spark):
    assert value(spark, S.clamp(F.lit(-3.0), lo=0.0)) == 0.0
    assert value(spark, S.clamp(F.lit(9.0), lo=0.0, hi=5.0)) == 5.0
    assert value(spark, S.clamp(F.lit(None).cast("double"), lo=0.0)) is None


@pytest.mark.parametrize("pue,want", [(1.09, "good"), (1.10, "fair"), (1.149, "fair"), (1.15, "poor"), (None, None)])
def test_ascending_band(spark, pue, want):
    assert value(spark, S.named_band(F.lit(pue).cast("double"), "pue")) == want


@pytest.mark.parametrize("score,want", [(80.0, "leader"), (79.9, "strong"), (65.0, "strong"), (64.9, "improve")])
def test_descending_inclusive_band(spark, score, want):
    assert value(spark, S.named_band(F.lit(score), "overall_score")) == want


def test_descending_exclusive_band(spark):
    assert value(spark, S.named_band(F.lit(70.0), "cfe_region")) == "fair"


def test_dates(spark):
    d = F.lit("2024-02-29").cast("date")
    assert value(spark, S.shift_year(d, -1)) == date(2023, 2, 28)
    assert value(spark, S.month_end(F.lit("2024-02-01").cast("date"))) == date(2024, 2, 29)
    assert value(spark, S.year_month(d)) == "2024-02"
    assert value(spark, S.parse_date(F.lit("nope"), lenient=True)) is None
    assert value(spark, S.as_of("2001-10-31")) == date(2001, 10, 31)


def test_display_text(spark):
    assert value(spark, S.display_number(F.lit(1234567.0), ",0")) == "1,234,567"
    assert value(spark, S.display_number(F.lit(1234567.0), "M")) == "1.23M"
    assert value(spark, S.display_number(F.lit(1.25), "+%")) in ("+1.3%", "+1.2%")
    assert value(spark, S.display_number(F.lit(None).cast("double"), "+%")) == "N/A"


def test_ratio_of_sums_differs_from_mean_of_ratios(spark):
    rows = spark.createDataFrame([(10.0, 1.0), (10.0, 9.0), (5.0, 0.0)], "a DOUBLE, b DOUBLE")
    got = rows.agg(Ag.ratio_of_sums("a", "b").alias("r"), Ag.mean_of_ratios("a", "b").alias("m"), Ag.mean("b").alias("x")).first()
    assert got["r"] == 2.5
    assert got["m"] == pytest.approx((10 + 10 / 9) / 2)
    assert got["x"] == pytest.approx(10 / 3)


def test_weighted_mean_and_conditional_count(spark):
    rows = spark.createDataFrame([(-45.0, 5.0), (15.0, 150.0), (None, 1.0)], "x DOUBLE, w DOUBLE")
    got = rows.agg(Ag.count_where(F.col("x") < 0).alias("n")).first()
    assert got["n"] == 1
    kept = rows.dropna().agg(Ag.weighted_mean("x", "w").alias("v")).first()
    assert kept["v"] == pytest.approx((-225 + 2250) / 155)
