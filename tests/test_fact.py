import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.operators.clean import clean_campaigns, counted_rows, dedupe_exact
from spendlens.operators.fact import FACT_COLUMNS, build_curated, curated_fact
from spendlens.operators.quality import unrated_rows

from feeds import PERF, literal_feeds

D = dt.date


@pytest.fixture(scope="module")
def fact(spark):
    return curated_fact(literal_feeds(spark)).cache()


def one(fact, condition):
    rows = fact.filter(condition).collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_columns_and_grain(fact):
    assert fact.columns == FACT_COLUMNS
    assert fact.count() == len(PERF) - 2  # one copy, one unreadable date


def test_campaign_dimension(spark):
    rows = {r["campaign_id"]: r for r in clean_campaigns(literal_feeds(spark)["campaigns"]).collect()}
    assert rows["C2"]["channel"] == "google_search"
    assert rows["C3"]["channel"] == "meta" and not rows["C3"]["is_running"]
    assert rows["C4"]["objective"] == "awareness" and rows["C4"]["currency"] == "USD"
    assert rows["C4"]["daily_budget"] is None and rows["C4"]["is_running"]
    assert rows["C5"]["end_date"] == D(2026, 6, 15) and not rows["C5"]["is_running"]


def test_copies_collapse_and_are_counted(spark):
    perf = literal_feeds(spark)["ad_performance_daily"]
    assert dedupe_exact(perf).count() == len(PERF) - 1
    assert sorted(r["copies"] for r in counted_rows(perf).collect())[-2:] == [1, 2]


def test_weekend_row_uses_fridays_rate(fact):
    row = one(fact, F.col("date") == D(2026, 6, 6))
    assert row["rate_to_usd"] == 0.012 and row["rate_was_filled"]
    assert row["spend_usd"] == pytest.approx(12.0)


def test_twice_delivered_rate_does_not_fan_out(fact):
    assert fact.filter((F.col("date") == D(2026, 6, 8)) & (F.col("campaign_id") == "C1")).count() == 1


def test_day_first_date_lands_in_june(fact):
    row = one(fact, "date_was_non_iso")
    assert row["date"] == D(2026, 6, 8)


def test_missing_revenue_is_not_zero(fact):
    row = one(fact, "revenue_missing")
    assert row["revenue_usd"] is None and row["spend_usd"] == pytest.approx(10.0)


def test_deleted_campaign_keeps_its_spend(fact):
    row = one(fact, "is_orphan_campaign")
    assert row["campaign_name"] == "(deleted campaign C99)"
    assert (row["channel"], row["objective"], row["is_running"]) == ("unattributed", "unknown", None)
    assert row["currency"] == "USD" and row["spend_usd"] == 3.0
    assert not row["currency_tag_mismatch"]


def test_campaign_currency_outranks_the_row(fact):
    row = one(fact, "currency_tag_mismatch")
    assert (row["campaign_id"], row["currency"]) == ("C3", "INR")
    assert row["spend_usd"] == pytest.approx(1.0)


def test_impossible_and_negative_rows_are_flagged_and_kept(fact):
    assert one(fact, "is_impossible_funnel")["clicks"] == 600
    assert one(fact, "is_negative_spend")["spend_usd"] == -5.0


def test_odd_numbers_become_numbers_or_null(fact):
    row = one(fact, (F.col("campaign_id") == "C2") & (F.col("date") == D(2026, 6, 5)))
    assert (row["impressions"], row["clicks"], row["conversions"]) == (12, None, 10)
    assert row["spend_local"] is None and row["revenue_local"] == 7.0
    assert row["is_impossible_funnel"] is None and row["is_negative_spend"] is None


def test_every_row_has_a_rate_and_the_guard_sees_a_missing_one(spark, fact):
    assert unrated_rows(fact).first()["unrated_rows"] == 0
    late = [("2026-06-08", "INR", "0.010"), ("2026-06-05", "USD", "1.0")]
    row = unrated_rows(curated_fact(literal_feeds(spark, rates=late))).first()
    assert row["unrated_rows"] == 2 and row["unrated_spend_local"] == 2000.0


def test_written_build_equals_the_lazy_fact(spark, fact, tmp_path):
    built = build_curated(spark, literal_feeds(spark), str(tmp_path))
    assert built.fact.drop("month").exceptAll(fact).count() == 0
    assert built.fact.count() == fact.count()


def test_shuffled_joins_give_the_same_fact(spark, fact):
    spread = curated_fact(literal_feeds(spark), limit=0)
    assert spread.exceptAll(fact).count() == 0 and spread.count() == fact.count()
