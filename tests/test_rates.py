import datetime as dt

from spendlens.operators.rates import (
    calendar, clean_rates, conflicting_keys, dense_rates, densify, first_and_last, rates_as_of, span_bounds,
)

D = dt.date


def rates(spark, rows):
    return clean_rates(spark.createDataFrame(rows, "date string, currency string, rate_to_usd string"))


def test_bounds_skip_nulls_and_span_all_sources(spark):
    a = spark.createDataFrame([(D(2026, 6, 3),), (None,)], "day date")
    b = spark.createDataFrame([(D(2026, 6, 1),), (D(2026, 6, 2),)], "day date")
    empty = spark.createDataFrame([], "day date")
    assert first_and_last(span_bounds(a, b, empty)) == (D(2026, 6, 1), D(2026, 6, 3))
    assert first_and_last(span_bounds(empty)) == (None, None)
    assert calendar(span_bounds(a, b)).count() == 3
    assert calendar(span_bounds(empty)).count() == 0


def test_identical_deliveries_collapse_and_bad_text_is_null(spark):
    rows = [("2026-06-08", "INR", "0.01"), ("2026-06-08", " inr", "0.010"), ("x", "INR", "y")]
    got = {tuple(r) for r in rates(spark, rows).collect()}
    assert got == {(D(2026, 6, 8), "INR", 0.01), (None, "INR", None)}
    assert rates(spark, rows).count() == 2


def test_weekend_inherits_friday_and_nothing_is_filled_backwards(spark):
    feed = rates(spark, [("2026-06-05", "INR", "0.012"), ("2026-06-08", "INR", "0.010")])
    dense = dense_rates(feed, D(2026, 6, 3), D(2026, 6, 9)).orderBy("day").collect()
    assert [r["rate_to_usd"] for r in dense] == [None, None, 0.012, 0.012, 0.012, 0.010, 0.010]
    assert [r["rate_was_filled"] for r in dense] == [True, True, False, True, True, False, True]


def test_currencies_do_not_lend_each_other_rates(spark):
    feed = rates(spark, [("2026-06-05", "INR", "0.012"), ("2026-06-06", "USD", "1")])
    got = {(r["day"].day, r["currency"]): r["rate_to_usd"] for r in dense_rates(feed, D(2026, 6, 5), D(2026, 6, 6)).collect()}
    assert got == {(5, "INR"): 0.012, (6, "INR"): 0.012, (5, "USD"): None, (6, "USD"): 1.0}


def test_unreadable_quote_counts_as_no_quote(spark):
    feed = rates(spark, [("2026-06-05", "INR", "0.012"), ("2026-06-06", "INR", "closed")])
    last = dense_rates(feed, D(2026, 6, 5), D(2026, 6, 6)).orderBy("day").collect()[-1]
    assert (last["rate_to_usd"], last["rate_was_filled"]) == (0.012, True)


def test_empty_span_gives_no_grid(spark):
    assert densify(rates(spark, [("2026-06-05", "INR", "1")]), None, None, "currency").count() == 0


def test_conflicting_quotes_are_found(spark):
    feed = rates(spark, [("2026-06-05", "INR", "0.012"), ("2026-06-05", "INR", "0.013"), ("2026-06-05", "USD", "1")])
    assert [tuple(r) for r in conflicting_keys(feed).collect()] == [(D(2026, 6, 5), "INR", 2)]


def test_rates_as_of_equal_the_dense_table(spark):
    feed = rates(spark, [("2026-06-05", "INR", "0.012"), ("2026-06-08", "INR", "0.010"), ("2026-06-06", "USD", "1"),
                         ("2026-06-07", "INR", "closed"), ("2026-06-01", "EUR", "?")])
    days = [D(2026, 6, d) for d in range(1, 13)]
    pairs = spark.createDataFrame([(d, c) for d in days for c in ("INR", "USD", "EUR")], "day date, currency string")
    dense = dense_rates(feed, days[0], days[-1])
    got = rates_as_of(pairs, feed)
    assert got.exceptAll(dense).count() == 0 and got.count() == dense.count()


def test_a_far_day_or_an_unknown_currency_costs_one_row(spark):
    feed = rates(spark, [("2026-06-05", "INR", "0.012"), ("2026-06-05", "INR", "0.013")])
    pairs = [(D(9999, 12, 31), "INR"), (D(9999, 12, 31), "INR"), (D(2026, 6, 5), "INR"), (D(2026, 6, 5), "XYZ")]
    got = sorted(map(tuple, rates_as_of(spark.createDataFrame(pairs, "day date, currency string"), feed).collect()), key=str)
    assert got == [(D(2026, 6, 5), "INR", 0.013, False), (D(2026, 6, 5), "XYZ", None, None), (D(9999, 12, 31), "INR", 0.013, True)]
