"""Scalar column expressions."""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from scopeledger.model.lookups import BANDS


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total_emissions() -> Column:
    """Market-basis total; NULL when any part is NULL."""
    return F.col("scope1_tonnes") + F.col("scope2_market_tonnes") + F.col("scope3_tonnes")


def year_of(d: str | Column) -> Column:
    return F.year(as_col(d))


def month_of(d: str | Column) -> Column:
    return F.month(as_col(d))


def year_month(d: str | Column) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")


def month_start(d: str | Column) -> Column:
    return F.trunc(as_col(d), "month")


def month_end(d: str | Column) -> Column:
    return F.last_day(as_col(d))


def month_index(d: str | Column) -> Column:
    """Months since year 0: consecutive calendar months differ by one."""
    return F.year(as_col(d)) * 12 + F.month(as_col(d))


def parse_date(c: str | Column, lenient: bool = False) -> Column:
    """ISO text to date; ``lenient`` yields NULL for text that is no date."""
    return F.try_to_date(as_col(c), "yyyy-MM-dd") if lenient else F.to_date(as_col(c), "yyyy-MM-dd")


def shift_year(d: str | Column, years: int) -> Column:
    return F.add_months(as_col(d), 12 * years)


def as_of(day: str | date | None = None) -> Column:
    return F.current_date() if day is None else F.lit(str(day)).cast("date")


def year_int(c: str | Column) -> Column:
    return as_col(c).cast("int")


def round_half_up(c: str | Column, places: int = 0) -> Column:
    return F.round(as_col(c), places)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Ratio as DOUBLE; NULL when the divisor is zero or either side is NULL."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def round_ratio(a: str | Column, b: str | Column, places: int) -> Column:
    """Rounded ratio in which binary noise past eight decimals does not decide ties."""
    return F.round(safe_div(a, b).cast("decimal(38,8)"), places).cast("double")


def pct_change(new: str | Column, old: str | Column) -> Column:
    new, old = as_col(new).cast("double"), as_col(old).cast("double")
    return safe_div(new - old, old) * 100


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clamp(c: str | Column, lo: Any = None, hi: Any = None) -> Column:
    """Limit to [lo, hi]; a NULL value stays NULL."""
    value = as_col(c)
    out = value
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(value.isNotNull(), out)


def label(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching label, else ``default``."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, text in cases[1:]:
        out = out.when(condition, F.lit(text))
    return out.otherwise(F.lit(default))


def coalesce_label(c: str | Column, text: str) -> Column:
    return F.coalesce(as_col(c), F.lit(text))


def band(
    c: str | Column,
    cuts: list[float],
    labels: list[str],
    direction: str = "asc",
    inclusive: bool = False,
) -> Column:
    """Label by threshold: ``asc`` takes the first cut the value is below, ``desc`` above."""
    value = as_col(c).cast("double")

    def hit(cut: float) -> Column:
        if direction == "asc":
            return value <= cut if inclusive else value < cut
        return value >= cut if inclusive else value > cut

    steps = [(value.isNull(), None)] + [(hit(float(k)), t) for k, t in zip(cuts, labels)]
    return label(steps, labels[-1])


def named_band(c: str | Column, name: str) -> Column:
    return band(c, *BANDS[name])


def display_number(c: str | Column, spec: str) -> Column:
    """Number as report text: ``,0`` grouped, ``+%`` signed percent, ``M``/``K`` scaled."""
    c = as_col(c).cast("double")
    if spec == "M":
        return F.format_string("%.2fM", c / 1_000_000)
    if spec == "K":
        return F.format_string("%.1fK", c / 1_000)
    if spec == "+%":
        return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%+.1f%%", c))
    if spec == "%":
        return F.format_string("%.1f%%", c)
    return F.format_number(c, int(spec.lstrip(",") or 0))


def date_literal(day: str | date | datetime) -> Column:
    return F.lit(str(day)[:10]).cast("date")
