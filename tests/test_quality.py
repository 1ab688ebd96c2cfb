import datetime as dt

import pytest

from spendlens.operators.fact import build_curated
from spendlens.operators.periods import Period
from spendlens.operators.quality import (
    caveats, missing_days, quality_report, relevant_caveats, relevant_codes, row_accounting,
)

from feeds import PERF, fact_frame, literal_feeds

D = dt.date


@pytest.fixture(scope="module")
def curated(spark):
    return build_curated(spark, literal_feeds(spark))


def test_rows_are_accounted_for(curated):
    row = row_accounting(curated.performance, curated.fact).first()
    assert row["raw_rows"] == len(PERF)
    assert (row["duplicates_removed"], row["unparseable_dates"]) == (1, 1)
    assert row["raw_rows"] - row["duplicates_removed"] - row["unparseable_dates"] == row["clean_rows"]


def test_report(curated):
    r = quality_report(curated).first().asDict()
    assert (r["raw_rows"], r["clean_rows"]) == (len(PERF), len(PERF) - 2)
    assert (r["non_iso_dates"], r["orphan_rows"], r["currency_mismatches"]) == (1, 1, 1)
    assert (r["fx_filled_rows"], r["negative_spend_rows"]) == (1, 1)
    assert (r["impossible_funnel_rows"], r["missing_revenue_rows"]) == (1, 1)
    assert (r["n_missing_days"], r["missing_days"]) == (1, "2026-06-07")
    assert (r["date_min"], r["date_max"]) == (D(2026, 6, 5), D(2026, 6, 8))
    # 12 + 12 + 10 + 50 - 5 + 1 + 20 + 3
    assert r["total_spend_usd"] == pytest.approx(103.0)


def test_only_caveats_with_a_count_are_listed(curated):
    got = {r["code"]: r["n"] for r in caveats(quality_report(curated)).collect()}
    assert len(got) == 9 and set(got.values()) == {1}
    none = quality_report(curated).selectExpr(*[f"0 as {c}" for c in got])
    assert caveats(none).count() == 0


@pytest.mark.parametrize(
    "name, group, codes",
    [
        ("clicks", "date", {"duplicates_removed"}),
        ("spend", "campaign", {"duplicates_removed", "fx_filled_rows"}),
        ("roas", "channel", {"duplicates_removed", "fx_filled_rows", "missing_revenue_rows", "orphan_rows"}),
        ("cpc", "none", {"duplicates_removed", "fx_filled_rows", "impossible_funnel_rows"}),
        ("ctr", "none", {"duplicates_removed", "impossible_funnel_rows"}),
    ],
)
def test_relevance(name, group, codes):
    assert set(relevant_codes(name, group)) == codes


def test_dated_caveats_follow_the_period_and_the_evidence(spark, curated):
    days = [D(2026, 6, 1) + dt.timedelta(days=i) for i in range(20) if i != 10]
    full = fact_frame(spark, [{"date": d} for d in days for _ in range(5)])
    short = fact_frame(spark, [{"date": d} for d in days for _ in range(1 if d == days[-1] else 5)])
    report = quality_report(curated)

    def codes(fact, lo, hi):
        rows = relevant_caveats(report, fact, "clicks", "none", Period(lo, hi)).collect()
        return {r["code"]: r["date"] for r in rows}

    assert codes(short, days[0], days[-1]) == {
        "duplicates_removed": None, "missing_day": D(2026, 6, 11), "partial_last_day": days[-1]}
    assert set(codes(full, days[0], days[-1])) == {"duplicates_removed", "missing_day"}
    assert set(codes(short, days[0], days[5])) == {"duplicates_removed"}


def test_missing_days_of_nothing(spark):
    assert missing_days(fact_frame(spark, []).limit(0)).count() == 0
