import datetime as dt
import statistics

import pytest

from spendlens.operators.anomaly import anomaly, flag_partial, last_day_check, last_day_ratios
from spendlens.operators.audit import daily_volume
from spendlens.operators.integrity import row_density
from spendlens.operators.periods import Period

from feeds import PERF_COLUMNS, fact_frame

START = dt.date(2026, 6, 1)
DAYS = 30


def day(i):
    return START + dt.timedelta(days=i)


def volume(i):
    """Rows of a day; one day is missing and the last one is short."""
    return 0 if i == 20 else 3 if i == DAYS - 1 else 10 + i % 3


@pytest.fixture(scope="module")
def fact(spark):
    rows = [
        {"date": day(i), "campaign_id": f"C{j}", "conversions": 0 if i == DAYS - 1 else 2 + i % 5}
        for i in range(DAYS)
        for j in range(volume(i))
    ]
    return fact_frame(spark, rows).cache()


def reported():
    return [i for i in range(DAYS) if volume(i)]


def test_trailing_median_uses_the_14_reported_days_before(fact):
    got = anomaly(fact, "conversions").collect()
    days = reported()
    assert [r["date"] for r in got] == [day(i) for i in days]
    assert got[0]["trailing_14d_median"] is None and got[0]["median_rows_reported"] is None
    for n, r in enumerate(got[1:], 1):
        past = days[max(0, n - 14):n]
        assert r["median_rows_reported"] == statistics.median(volume(i) for i in past)
        median = statistics.median(volume(i) * (2 + i % 5) for i in past)
        assert abs(r["trailing_14d_median"] - median) <= 0.5


def test_short_last_day_is_suspect_by_rows_and_metric(fact):
    flags = flag_partial(anomaly(fact, "conversions"), "conversions").collect()
    assert flags[-1]["metric_suspect"] and flags[-1]["rows_suspect"]
    assert not any(r["rows_suspect"] for r in flags[:-1])
    assert not flags[0]["metric_suspect"]
    assert [r["date"] for r in row_density(fact).collect()] == [day(DAYS - 1)]


def test_window_is_widened_for_a_single_day(fact):
    last = day(DAYS - 1)
    got = anomaly(fact, "conversions", Period(last, last)).collect()
    assert got[0]["date"] == last - dt.timedelta(days=21)


def test_ratio_series_keeps_a_zero_denominator_null(fact):
    got = anomaly(fact, "cpa").collect()
    assert got[-1]["cpa_usd"] is None and got[-1]["trailing_14d_median"] is not None


def test_last_day_against_15_calendar_days(fact):
    row = last_day_check(fact).first()
    past = [i for i in range(DAYS - 16, DAYS - 1) if volume(i)]
    assert row["median_rows"] == statistics.median(volume(i) for i in past)
    assert row["n_rows"] == 3 and row["conversions"] == 0
    assert row["rows_pct_of_median"] == round(100 * 3 / row["median_rows"])
    assert row["conv_pct_of_median"] == 0


def test_last_day_against_14_reported_days(spark):
    rows = [
        (day(i).isoformat(), f"C{j}", "K", "100", "1", "2", "1.5", "1", "INR")
        for i in range(DAYS) for j in range(volume(i))
    ]
    perf = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PERF_COLUMNS))
    got = {r["measure"]: r for r in last_day_ratios(daily_volume(perf)).collect()}
    past = reported()[-15:-1]
    median = statistics.median(volume(i) for i in past)
    assert set(got) == {"n_rows", "campaigns", "impressions", "conversions", "spend"}
    assert got["campaigns"]["median_value"] == median and got["campaigns"]["last_value"] == 3
    assert got["spend"]["median_value"] == median * 1.5
    assert all(r["looks_partial"] and r["ratio"] == round(3 / median, 4) for r in got.values())


def test_a_series_for_each_entity_has_its_own_past_and_its_own_gaps(spark):
    import datetime as dt

    import pytest

    first = dt.date(2026, 1, 1)
    rows = []
    for i in range(20):
        rows += [(first + dt.timedelta(days=i), "hot", 1)] * 40
        if i not in (5, 6, 7):
            rows.append((first + dt.timedelta(days=i), "rare", 0 if i == 10 else 2))
    rows.append((first + dt.timedelta(days=3), None, 7))
    fact = spark.createDataFrame(rows, "date date, channel string, conversions long")
    got = {(r.channel, (r.date - first).days): r for r in anomaly(fact, "conversions", by="channel").collect()}
    assert len(got) == 20 + 17 + 1
    assert {got["hot", i].conversions for i in range(20)} == {40} and got["hot", 19].trailing_14d_median == 40
    # A day of zero is a row, days without rows are not, and are told of on the next day.
    assert got["rare", 10].conversions == 0 and ("rare", 5) not in got
    assert [got["rare", i].days_without_rows for i in (0, 4, 8, 9)] == [0, 0, 3, 0]
    assert got["rare", 8].trailing_14d_median == 2 and got["rare", 0].trailing_14d_median is None
    assert got[None, 3].conversions == 7 and got[None, 3].median_rows_reported is None
    with pytest.raises(ValueError):
        anomaly(fact, "conversions", by="date")
