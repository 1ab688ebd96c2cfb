import datetime as dt

import pytest

from spendlens.operators.periods import (
    Period, PeriodError, anomaly_window, between, data_span, in_period, period_totals, resolve,
)

from feeds import fact_frame

D = dt.date
SPAN = (D(2026, 6, 8), D(2026, 9, 4))


@pytest.mark.parametrize(
    "kind, n, lo",
    [
        ("last_n_days", 7, D(2026, 8, 28)),
        ("last_n_weeks", 8, D(2026, 7, 10)),
        ("last_n_months", 2, D(2026, 7, 6)),
        ("quarter_to_date", 0, D(2026, 7, 1)),
        ("month_to_date", 0, D(2026, 9, 1)),
        ("most_recent_day", 0, D(2026, 9, 4)),
        ("all_time", 0, D(2026, 6, 8)),
    ],
)
def test_kinds_anchor_on_the_last_day_of_the_data(kind, n, lo):
    assert resolve(kind, SPAN, n) == Period(lo, D(2026, 9, 4), kind)


def test_eight_weeks_are_57_dates():
    p = resolve("last_n_weeks", SPAN, 8)
    assert (p.hi - p.lo).days + 1 == 57


@pytest.mark.parametrize("month, first", [(1, 1), (3, 1), (4, 4), (9, 7), (12, 10)])
def test_quarter_start(month, first):
    assert resolve("quarter_to_date", (D(2025, 1, 1), D(2026, month, 15))).lo == D(2026, first, 1)


def test_period_sticking_out_is_clamped_with_warnings():
    p = resolve("explicit", SPAN, start=D(2025, 1, 1), end=D(2026, 12, 31))
    assert (p.lo, p.hi) == SPAN and len(p.warnings) == 2 and "data begins" in p.warnings[0]
    assert resolve("last_n_months", SPAN, 12).lo == SPAN[0]


@pytest.mark.parametrize(
    "kind, args",
    [
        ("explicit", {"start": D(2024, 1, 1), "end": D(2024, 6, 30)}),
        ("explicit", {"start": D(2027, 1, 1), "end": D(2027, 6, 30)}),
        ("explicit", {"start": D(2026, 8, 2), "end": D(2026, 8, 1)}),
        ("explicit", {"start": D(2026, 8, 2)}),
        ("last_n_days", {"n": 0}),
        ("last_n_weeks", {"n": -1}),
        ("last_fortnight", {}),
    ],
)
def test_unanswerable_periods_are_refused(kind, args):
    with pytest.raises(PeriodError):
        resolve(kind, SPAN, **args)


def test_anomaly_needs_three_weeks():
    assert anomaly_window(Period(D(2026, 9, 4), D(2026, 9, 4))).lo == D(2026, 8, 14)
    wide = Period(D(2026, 7, 1), D(2026, 9, 4))
    assert anomaly_window(wide) == wide


def test_filter_is_inclusive_and_prunes_months(spark, tmp_path):
    from spendlens.operators.fact import write_curated

    fact = fact_frame(spark, [{"date": D(2026, m, d)} for m in (6, 7, 8) for d in (1, 15, 28)])
    stored = write_curated(fact, str(tmp_path / "f"))
    p = Period(D(2026, 6, 15), D(2026, 7, 15))
    assert in_period(fact, p).count() == in_period(stored, p).count() == 4
    plan = in_period(stored, p)._jdf.queryExecution().executedPlan().toString()
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in partitions and "202606" in partitions
    assert "GreaterThanOrEqual(date,2026-06-15)" in plan
    assert in_period(stored, resolve("all_time", data_span(stored))) is stored
    assert stored.filter(between(stored, D(2026, 8, 1), D(2026, 8, 1))).count() == 1


def test_empty_data_has_no_span(spark):
    with pytest.raises(PeriodError):
        data_span(fact_frame(spark, []).limit(0))


def test_totals(spark):
    fact = fact_frame(spark, [{"date": D(2026, 6, d), "spend_usd": float(d)} for d in (1, 2, 9)])
    p = resolve("last_n_days", data_span(fact), 7)
    assert tuple(period_totals(fact, p).first()) == ("last_n_days", D(2026, 6, 2), D(2026, 6, 9), 0, 2, 11.0)
