"""Limits and top-k. Global limits plan as TakeOrderedAndProject; grouped ones let
Spark cut each task to k rows per group before the shuffle (window group limit)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.functions.scalars import safe_div


def latest_n(df: DataFrame, order: str, n: int, p: Sequence[str] = ()) -> DataFrame:
    if not p:
        return df.orderBy(F.col(order).desc()).limit(n)
    return top_k(df, order, [], n, p)


def top_k(df: DataFrame, score: str, tie: Sequence[str], k: int, p: Sequence[str] = ()) -> DataFrame:
    order = [F.col(score).desc(), *tie]
    if not p:
        return df.orderBy(*order).limit(k)
    numbered = df.withColumn("_n", F.row_number().over(W.partitionBy(*p).orderBy(*order)))
    return numbered.filter(F.col("_n") <= k).drop("_n")


def first_n(df: DataFrame, order: str, n: int, p: Sequence[str] = ()) -> DataFrame:
    if not p:
        return df.orderBy(order).limit(n)
    numbered = df.withColumn("_n", F.row_number().over(W.partitionBy(*p).orderBy(order)))
    return numbered.filter(F.col("_n") <= n).drop("_n")


def top_share(df: DataFrame, value: str, tie: Sequence[str], k: int) -> DataFrame:
    """Percent of the grand total held by the k largest rows."""
    head = top_k(df, value, tie, k).agg(F.sum(value).alias("top_value"))
    whole = df.agg(F.sum(value).alias("total_value"))
    return head.crossJoin(F.broadcast(whole)).withColumn(
        "top_share_pct", safe_div(F.col("top_value").cast("double") * 100, "total_value")
    )
