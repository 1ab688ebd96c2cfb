"""Periods anchored on the last day of the data, never on the clock."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.numbers import rounded
from spendlens.operators.rates import first_and_last, span_bounds
from spendlens.plans.store import MONTH

# Days per unit; a month counts as thirty days.
UNIT_DAYS = {"last_n_days": 1, "last_n_weeks": 7, "last_n_months": 30}
KINDS = [
    *UNIT_DAYS, "quarter_to_date", "month_to_date", "most_recent_day", "all_time", "explicit",
]
# The shortest history a daily movement is judged against.
ANOMALY_MIN_DAYS = 21


class PeriodError(ValueError):
    """The requested period cannot be answered from the data."""


@dataclass(frozen=True)
class Period:
    """Two dates, both included, and what had to be said about them."""

    lo: dt.date
    hi: dt.date
    kind: str = "explicit"
    warnings: tuple[str, ...] = ()


def data_span(fact: DataFrame, day: str = "date") -> tuple[dt.date, dt.date]:
    lo, hi = first_and_last(span_bounds(fact, day=day))
    if lo is None:
        raise PeriodError("the data holds no dated row")
    return lo, hi


def resolve(
    kind: str,
    span: tuple[dt.date, dt.date],
    n: int = 0,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> Period:
    """A period kind as two dates within the data.

    "Last n" reaches n units back from the last day and includes it, so the last
    seven days are eight dates. A period that sticks out of the data is clamped
    with a warning; one entirely outside is refused.
    """
    first, last = span
    if kind in UNIT_DAYS:
        if n <= 0:
            raise PeriodError(f"{kind} needs a positive n")
        lo, hi = last - dt.timedelta(days=n * UNIT_DAYS[kind]), last
    elif kind == "quarter_to_date":
        lo, hi = last.replace(month=last.month - (last.month - 1) % 3, day=1), last
    elif kind == "month_to_date":
        lo, hi = last.replace(day=1), last
    elif kind == "most_recent_day":
        lo, hi = last, last
    elif kind == "all_time":
        lo, hi = first, last
    elif kind == "explicit":
        if start is None or end is None:
            raise PeriodError("an explicit period needs both dates")
        lo, hi = start, end
    else:
        raise PeriodError(f"unknown period kind {kind!r}; expected one of {KINDS}")
    return clamp(Period(lo, hi, kind), span)


def clamp(period: Period, span: tuple[dt.date, dt.date]) -> Period:
    first, last = span
    if period.lo > period.hi:
        raise PeriodError(f"{period.lo} is after {period.hi}")
    if period.lo > last or period.hi < first:
        raise PeriodError(f"{period.lo} to {period.hi} is outside the data, {first} to {last}")
    warnings = list(period.warnings)
    if period.lo < first:
        warnings.append(f"requested from {period.lo}, the data begins {first}")
    if period.hi > last:
        warnings.append(f"requested up to {period.hi}, the data stops {last}")
    return replace(
        period, lo=max(period.lo, first), hi=min(period.hi, last), warnings=tuple(warnings)
    )


def anomaly_window(period: Period) -> Period:
    """At least three weeks up to the end of the period."""
    return replace(period, lo=min(period.lo, period.hi - dt.timedelta(days=ANOMALY_MIN_DAYS)))


def between(df: DataFrame, lo: dt.date, hi: dt.date, day: str = "date") -> Column:
    """Inclusive day filter; a table laid out by month is pruned to its folders."""
    inside = F.col(day).between(F.lit(lo), F.lit(hi))
    if MONTH in df.columns:
        inside &= F.col(MONTH).between(lo.year * 100 + lo.month, hi.year * 100 + hi.month)
    return inside


def in_period(df: DataFrame, period: Period | None, day: str = "date") -> DataFrame:
    """Rows of the period. The whole table needs no filter at all."""
    if period is None or period.kind == "all_time":
        return df
    return df.filter(between(df, period.lo, period.hi, day))


def period_totals(fact: DataFrame, period: Period) -> DataFrame:
    """The resolved dates beside what the period holds."""
    return (
        in_period(fact, period)
        .agg(F.count("*").alias("n_rows"), rounded(F.sum("spend_usd"), 2).alias("spend_usd"))
        .select(
            F.lit(period.kind).alias("period_kind"),
            F.lit(period.lo).alias("date_from"),
            F.lit(period.hi).alias("date_to"),
            F.lit(len(period.warnings)).cast("bigint").alias("n_warnings"),
            "n_rows",
            "spend_usd",
        )
    )
