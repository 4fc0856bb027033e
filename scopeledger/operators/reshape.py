"""Unpivot, long grids and report renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_report(df: DataFrame, ids: Sequence[str], values: dict[str, str], name: str, value: str) -> DataFrame:
    """Columns to (name, value) rows; ``values`` maps column to its label."""
    same = df.select(*ids, *[F.col(c).cast("double").alias(text) for c, text in values.items()])
    return same.unpivot(list(ids), list(values.values()), name, value)


def stack_rows(df: DataFrame, ids: Sequence[str], names: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """Several output rows per input row, each a list of columns named ``names``."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return df.select(*ids, F.inline(F.array(*structs)))


def matrix(df: DataFrame, rows: str, columns: str, value: str, column_values: Sequence | None = None) -> DataFrame:
    """Long form to a matrix; give ``column_values`` to avoid a pass that finds them."""
    return df.groupBy(rows).pivot(columns, list(column_values) if column_values else None).agg(F.first(value))


def rename_report(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)
