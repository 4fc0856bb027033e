"""Batch validation: rules are predicates that good rows satisfy.

Row rules are evaluated in one pass over the rows. Rules about keys (uniqueness,
foreign keys) are decided on aggregated keys and joined back by the planner:
few bad keys are broadcast at run time, many are merged and skewed ones split.
Everything is lazy, and the summary is one aggregate of the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.functions.aggregates import count_where
from scopeledger.functions.scalars import as_of, safe_div
from scopeledger.model import schemas as S
from scopeledger.operators.calendar import missing_months
from scopeledger.operators.joins import null_safe_join

__all__ = [
    "Rule", "emission_rules", "business_rules", "facility_rules", "target_rules", "category_rules",
    "factor_rules", "row_summary", "duplicate_keys", "dedupe", "validate", "summary", "missing_months", "completeness",
]


@dataclass(frozen=True)
class Rule:
    """A row rule: ``holds`` is NULL or true for good rows."""

    rule_id: str
    severity: str
    holds: Column = field(compare=False)

    def broken(self) -> Column:
        return F.coalesce(~self.holds, F.lit(False))


def _present(columns: Sequence[str]) -> list[Rule]:
    return [Rule(f"not_null:{c}", "error", F.col(c).isNotNull()) for c in columns]


def _non_negative(columns: Sequence[str]) -> list[Rule]:
    return [Rule(f"non_negative:{c}", "error", F.col(c) >= 0) for c in columns]


def _one_of(column: str, values: Sequence[str]) -> Rule:
    return Rule(f"allowed:{column}", "error", F.col(column).isin(list(values)))


def _between(column: str, lo: float, hi: float) -> Rule:
    return Rule(f"range:{column}", "error", F.col(column).between(lo, hi))


SCOPE_COLUMNS = ["scope1_tonnes", "scope2_location_tonnes", "scope2_market_tonnes", "scope3_tonnes"]


def emission_rules(day: str | date | None = None, flagged: bool = False) -> list[Rule]:
    """Rules of the emissions fact; ``day`` is the latest admissible date (today by default)."""
    rules = [
        *_present(["facility_id", "date", *SCOPE_COLUMNS]),
        *_non_negative([*SCOPE_COLUMNS, "electricity_mwh"]),
        _between("renewable_pct", 0, 100),
        Rule("market_not_above_location", "error", F.col("scope2_market_tonnes") <= F.col("scope2_location_tonnes")),
        Rule("date_not_in_future", "error", F.col("date") <= as_of(day)),
    ]
    return rules + [_one_of("data_quality_flag", S.QUALITY_FLAGS)] if flagged else rules


def business_rules() -> list[Rule]:
    measures = ["revenue_millions", "headcount", "square_feet", "server_count"]
    return [*_present(["facility_id", "date"]), *_non_negative(measures)]


def facility_rules(full: bool = False) -> list[Rule]:
    rules = [
        *_present(["facility_id", "facility_name", "region", "facility_type"]),
        _one_of("facility_type", S.FACILITY_TYPES),
    ]
    if full:
        rules += [_between("typical_renewable_pct", 0, 100), _one_of("relative_size", S.RELATIVE_SIZES)]
    return rules


def factor_rules() -> list[Rule]:
    return [_one_of("scope", S.SCOPES), *_non_negative(["emission_factor"])]


def target_rules() -> list[Rule]:
    return [
        *_non_negative(["baseline_emissions", "target_emissions"]),
        Rule("target_after_baseline", "error", F.col("target_year") > F.col("baseline_year")),
    ]


def category_rules() -> list[Rule]:
    return [
        _between("category_id", 1, 15), *_non_negative(["typical_pct_of_scope3"]),
        _one_of("upstream_downstream", S.STREAMS),
    ]


def _pass_rows(checks: list[tuple[str, str, Column]], n: Column) -> Column:
    """Array of (rule, severity, failed, pass_rate_pct) structs."""
    return F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), failed.alias("failed"),
            F.round(safe_div((n - failed) * 100.0, n), 2).alias("pass_rate_pct"),
        )
        for rule, severity, failed in checks
    ])


def row_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failures and pass rate of every row rule from one aggregation."""
    counts = [count_where(r.broken()).alias(f"f{i}") for i, r in enumerate(rules)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    checks = [(r.rule_id, r.severity, F.col(f"f{i}")) for i, r in enumerate(rules)]
    return one.select(F.inline(_pass_rows(checks, F.col("n"))))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def dedupe(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by all remaining columns.

    Taken as an aggregate, which combines map-side, not as a window over the copies.
    """
    rest = [c for c in df.columns if c not in key]
    smallest = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return smallest.select(*key, "_row.*").select(*df.columns)


def _bad_keys(
    df: DataFrame, key: Sequence[str], references: dict[str, DataFrame], once: bool = True
) -> DataFrame:
    """Keys that are repeated (if each may occur ``once``) or refer to nothing, from one pass over the rows."""
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    flags = [(whole & (F.col("_rows") > 1)).alias("_repeated")] if once else []
    for column, dim in references.items():
        known = dim.select(column).withColumn(f"_known_{column}", F.lit(True))
        keys = keys.join(known, column, "left")
        flags.append((F.col(column).isNotNull() & F.col(f"_known_{column}").isNull()).alias(f"_lost_{column}"))
    names = (["_repeated"] if once else []) + [f"_lost_{c}" for c in references]
    hit = F.lit(False)
    for name in names:
        hit = hit | F.col(name)
    return keys.select(*key, *flags).filter(hit)


def validate(
    df: DataFrame,
    rules: Sequence[Rule],
    unique: Sequence[str] = (),
    references: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split rows into clean and quarantined, with a summary by rule.

    Quarantined rows carry ``failed_rules``. Every row of a repeated ``unique``
    key is quarantined. ``references`` maps a column to the dimension holding it.
    """
    references = references or {}
    failed = [F.when(r.broken(), F.lit(r.rule_id)) for r in rules]
    names = [r.rule_id for r in rules]
    marked = df
    if unique:
        covered = {c: dim for c, dim in references.items() if c in unique}
        marked = null_safe_join(marked, _bad_keys(df, unique, covered), unique, "left")
        names.append("unique:" + ",".join(unique))
        failed.append(F.when(F.col("_repeated"), F.lit(names[-1])))
    for column, dim in references.items():
        if column not in unique:
            marked = null_safe_join(marked, _bad_keys(df, [column], {column: dim}, once=False), [column], "left")
        names.append(f"reference:{column}")
        failed.append(F.when(F.col(f"_lost_{column}"), F.lit(names[-1])))
    tagged = marked.withColumn("failed_rules", F.array_compact(F.array(*failed))).select(*df.columns, "failed_rules")
    clean = tagged.filter(F.size("failed_rules") == 0).drop("failed_rules")
    quarantined = tagged.filter(F.size("failed_rules") > 0)
    return clean, quarantined, summary(tagged, names)


def summary(tagged: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows per failed rule of ``names``, most frequent first, next to the row count, from one aggregate."""
    counts = [F.count_if(F.array_contains("failed_rules", name)).alias(f"f{i}") for i, name in enumerate(names)]
    one = tagged.agg(F.count(F.lit(1)).alias("total_rows"), *counts)
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("failed")) for i, name in enumerate(names)])
    per_rule = one.select("total_rows", F.inline(rules)).where("failed > 0")
    return per_rule.select(
        "rule", "failed", "total_rows", F.round(safe_div((F.col("total_rows") - F.col("failed")) * 100.0, "total_rows"), 2).alias("pass_rate_pct")
    ).orderBy(F.col("failed").desc(), "rule")


def completeness(df: DataFrame, date_col: str, p: Sequence[str]) -> DataFrame:
    """Months present, expected and missing of each series."""
    span = F.months_between(F.max(date_col), F.min(date_col)).cast("int") + 1
    return df.groupBy(*p).agg(
        F.count_distinct(date_col).alias("present"), span.alias("expected")
    ).withColumn("missing", F.col("expected") - F.col("present"))

