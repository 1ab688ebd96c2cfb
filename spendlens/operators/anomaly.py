"""Daily movement against its own recent past, and partial last days.

Windows here run over daily totals, one row per calendar day, so ordering them in
one task stays bounded by the calendar however many rows a day holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.metrics import grouping_column, metric
from spendlens.functions.numbers import median_of, rounded
from spendlens.operators.periods import Period, anomaly_window, between, data_span, in_period

TRAILING_ROWS = 14
TRAILING_DAYS = 15
SUSPECT_SHARE = 0.6


def _trailing_median(value: Column, entity: list[str]) -> Column:
    """Median of the 14 reported days before the current one, of the same entity."""
    past = Window.partitionBy(*entity).orderBy("date").rowsBetween(-TRAILING_ROWS, -1)
    return median_of(F.collect_list(value).over(past))


def anomaly(fact: DataFrame, name: str, period: Period | None = None, by: str | None = None) -> DataFrame:
    """A metric per day beside the rows reported, each with its trailing median.

    With ``by`` there is a series for every value of a grouping, each against its own past.
    Rows are summed to one per entity and day before any window, so an entity with very many
    rows is no larger than the calendar. A day on which an entity has no rows is not
    a day with zero: it has no row in the series and is counted in the
    ``days_without_rows`` of the next day that has.
    """
    m = metric(name)
    entity = [] if by is None else [grouping_column(by)]
    if by is not None and entity in ([None], ["date"]):
        raise ValueError(f"no series by {by!r}")
    scope = in_period(fact, period and anomaly_window(period))
    daily = scope.groupBy(*entity, "date").agg(m.total().alias("value"), F.count("*").alias("rows_reported"))
    earlier = F.lag("date").over(Window.partitionBy(*entity).orderBy("date"))
    gap = [(F.coalesce(F.datediff("date", earlier), F.lit(1)) - 1).cast("bigint").alias("days_without_rows")] if entity else []
    return daily.select(
        *entity,
        "date",
        m.rounded(F.col("value")).alias(m.label),
        "rows_reported",
        m.rounded(_trailing_median(F.col("value"), entity)).alias("trailing_14d_median"),
        rounded(_trailing_median(F.col("rows_reported"), entity), 1).alias("median_rows_reported"),
        *gap,
    ).orderBy(*entity, "date")


def flag_partial(series: DataFrame, label: str) -> DataFrame:
    """Days whose metric or row count falls far below the trailing median."""

    def far_below(value: Column, median: Column) -> Column:
        return F.coalesce((median != 0) & (value < median * SUSPECT_SHARE), F.lit(False))

    value = F.coalesce(F.col(label), F.lit(0))
    return series.withColumns(
        {
            "metric_suspect": far_below(value, F.col("trailing_14d_median")),
            "rows_suspect": far_below(F.col("rows_reported"), F.col("median_rows_reported")),
        }
    )


def last_day_check(fact: DataFrame, last: dt.date | None = None) -> DataFrame:
    """The last day as a share of the median of the 15 calendar days before it.

    Only those days are read.
    """
    last = last or data_span(fact)[1]
    first = last - dt.timedelta(days=TRAILING_DAYS)
    daily = (
        fact.filter(between(fact, first, last))
        .groupBy("date")
        .agg(F.count("*").alias("n"), F.sum("conversions").alias("conv"))
    )
    is_last = F.col("date") == F.lit(last)

    def on_last(c: str) -> Column:
        return F.max(F.when(is_last, F.col(c)))

    def before(c: str) -> Column:
        return F.median(F.when(~is_last, F.col(c)))

    return daily.agg(
        F.max("date").alias("last_day"),
        on_last("n").alias("n_rows"),
        before("n").alias("median_rows"),
        on_last("conv").alias("conversions"),
        before("conv").alias("median_conversions"),
    ).select(
        "last_day",
        "n_rows",
        "median_rows",
        rounded(F.try_divide(100.0 * F.col("n_rows"), F.col("median_rows")), 0).alias(
            "rows_pct_of_median"
        ),
        "conversions",
        "median_conversions",
        rounded(F.try_divide(100.0 * F.col("conversions"), F.col("median_conversions")), 0).alias(
            "conv_pct_of_median"
        ),
    )


VOLUME = ["n_rows", "campaigns", "impressions", "conversions", "spend"]


def last_day_ratios(daily: DataFrame, min_days: int = TRAILING_ROWS + 1) -> DataFrame:
    """Every volume figure of the last reported day against the 14 days before it.

    With fewer than ``min_days`` reported days there is no past to judge by: the
    ratio is NULL then and nothing looks partial.
    """
    recent = daily.orderBy(F.col("date").desc()).limit(TRAILING_ROWS + 1)
    newest = F.row_number().over(Window.orderBy(F.col("date").desc())) == 1
    tagged = recent.withColumn("is_last", newest)
    doubles = [F.col(c).cast("double").alias(c) for c in VOLUME]
    long = tagged.select("date", "is_last", *doubles).unpivot(
        ["date", "is_last"], VOLUME, "measure", "value"
    )
    judged = F.when(F.col("days") >= min_days, F.col("last_value"))
    ratio = F.try_divide(judged, F.nullif(F.col("median_value"), F.lit(0.0)))
    return (
        long.groupBy("measure")
        .agg(
            F.max("date").alias("last_day"),
            F.count("*").alias("days"),
            F.max(F.when(F.col("is_last"), F.col("value"))).alias("last_value"),
            median_of(F.collect_list(F.when(~F.col("is_last"), F.col("value")))).alias("median_value"),
        )
        .select(
            "measure",
            "last_day",
            rounded("last_value", 2).alias("last_value"),
            rounded("median_value", 2).alias("median_value"),
            rounded(ratio, 4).alias("ratio"),
            F.coalesce(ratio < SUSPECT_SHARE, F.lit(False)).alias("looks_partial"),
        )
    )
