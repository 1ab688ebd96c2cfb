"""Exchange rates: a sparse feed made dense by day and currency."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.text import ISO, norm_code, parse_dates, safe_double


def clean_rates(raw: DataFrame) -> DataFrame:
    return raw.select(
        parse_dates("date", (ISO,)).alias("day"),
        norm_code("currency").alias("currency"),
        safe_double("rate_to_usd").alias("rate_to_usd"),
    ).distinct()


def span_bounds(*sources: DataFrame, day: str = "day") -> DataFrame:
    """One row with the first and last day over all sources, NULLs skipped."""
    ends = [s.agg(F.min(day).alias("lo"), F.max(day).alias("hi")) for s in sources]
    both = ends[0]
    for other in ends[1:]:
        both = both.unionByName(other)
    return both.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def first_and_last(bounds: DataFrame) -> tuple[dt.date | None, dt.date | None]:
    """The two dates of a ``span_bounds`` row, as literals later filters prune with."""
    row = bounds.first()
    return row["lo"], row["hi"]


def calendar(bounds: DataFrame, day: str = "day") -> DataFrame:
    """Every day from ``lo`` to ``hi`` of a bounds row."""
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias(day))


def densify(feed: DataFrame, lo: dt.date | None, hi: dt.date | None, key: str, day: str = "day") -> DataFrame:
    """A row for every key and day of the span, with the feed's values where present.

    Each key unfolds its own calendar, so nothing is paired with everything.
    """
    first, last = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    grid = (
        feed.filter(F.col(key).isNotNull())
        .select(key)
        .distinct()
        .withColumn(day, F.explode(F.sequence(first, last)))
    )
    return grid.join(feed, [key, day], "left")


def ffill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Carry the last known value forward per key and flag the carried rows.

    Nothing is filled backwards: days before the first value stay NULL. Should a
    day hold several values, the highest is the one carried on.
    """
    upto_now = (
        Window.partitionBy(key)
        .orderBy(F.col(order), F.col(value).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns(
        {
            value: F.last(value, ignorenulls=True).over(upto_now),
            "rate_was_filled": F.col(value).isNull(),
        }
    )


def dense_rates(rates: DataFrame, lo: dt.date | None, hi: dt.date | None) -> DataFrame:
    filled = ffill(densify(rates, lo, hi, "currency"), "currency", "day", "rate_to_usd")
    return filled.select("day", "currency", "rate_to_usd", "rate_was_filled")


def rates_as_of(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rate of each (day, currency) pair: that of the latest quote up to its day.

    One row per pair in use, however far its day lies from the others. Days before
    the first quote get none; a pair of a currency that is never quoted gets no flag
    either. Of several quotes for one day the highest counts.
    """
    asked = pairs.select("currency", "day").distinct().withColumns({"quote": F.lit(None).cast("double"), "asked": F.lit(1)})
    quoted = rates.groupBy("currency", "day").agg(F.max("rate_to_usd").alias("quote")).withColumn("asked", F.lit(0))
    rows = asked.unionByName(quoted.filter(F.col("currency").isNotNull()))
    # One row per day a currency is quoted or used on, so no partition outgrows the calendar.
    so_far = Window.partitionBy("currency").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    known = F.min("asked").over(Window.partitionBy("currency")) == 0
    on = F.last(F.when(F.col("quote").isNotNull(), F.col("day")), ignorenulls=True).over(so_far)
    dated = rows.withColumns({"rate_to_usd": F.last("quote", ignorenulls=True).over(so_far), "on": on, "known": known})
    return dated.filter("asked = 1").select(
        "day", "currency", "rate_to_usd", F.when(F.col("known"), ~F.col("on").eqNullSafe(F.col("day"))).alias("rate_was_filled")
    )


def conflicting_keys(rates: DataFrame) -> DataFrame:
    """Day and currency pairs quoted with different rates; the fact uses the highest."""
    return (
        rates.groupBy("day", "currency")
        .agg(F.count("*").alias("n_rates"))
        .filter(F.col("n_rates") > 1)
    )
