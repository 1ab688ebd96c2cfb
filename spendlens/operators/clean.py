"""Typed, deduplicated dimensions and performance rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.text import (
    ISO, non_iso_flag, norm_category, norm_code, norm_label, parse_dates, safe_double,
)
from spendlens.sources.feeds import data_columns


def clean_campaigns(raw: DataFrame) -> DataFrame:
    """Campaign dimension with canonical categories.

    A campaign runs while its raw end date is blank; a date that is set, even one
    in the future or an unreadable one, counts as ended.
    """
    return raw.select(
        "campaign_id",
        "campaign_name",
        norm_category("channel").alias("channel"),
        norm_label("objective").alias("objective"),
        norm_code("currency").alias("currency"),
        safe_double("daily_budget").alias("daily_budget"),
        parse_dates("start_date", (ISO,)).alias("start_date"),
        parse_dates("end_date", (ISO,)).alias("end_date"),
        F.col("end_date").isNull().alias("is_running"),
    )


def dedupe_exact(df: DataFrame) -> DataFrame:
    """One row of each set of fully identical rows.

    Copies are merged before the shuffle, so any number of them costs one row per
    map task.
    """
    return df.dropDuplicates()


def counted_rows(df: DataFrame) -> DataFrame:
    """Like ``dedupe_exact``, and ``copies`` tells how often the row arrived."""
    return df.groupBy(*data_columns(df)).agg(F.count("*").alias("copies"))


def dated(df: DataFrame) -> DataFrame:
    """Adds the parsed ``day`` and the non-ISO flag; no row is dropped."""
    return df.withColumns({"day": parse_dates("date"), "date_was_non_iso": non_iso_flag("date")})


def dated_performance(raw: DataFrame) -> DataFrame:
    return dated(counted_rows(raw))
