import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions import text as t


def values(spark, rows, expr):
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    return [r[0] for r in df.select(expr).collect()]


def test_categories_are_trimmed_lowered_and_joined(spark):
    raw = ["Meta ", "YouTube", " Google Search", None]
    assert values(spark, raw, t.norm_category("c")) == ["meta", "youtube", "google_search", None]
    assert values(spark, [" usd", "Inr"], t.norm_code("c")) == ["USD", "INR"]
    assert values(spark, [" Awareness "], t.norm_label("c")) == ["awareness"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("12", 12), (" 12 ", 12), ("12.0", 12), ("12.5", 13), ("-3", -3), ("1e3", 1000),
        ("abc", None), ("", None), (None, None), ("99999999999999999999", None),
    ],
)
def test_safe_long(spark, raw, want):
    assert values(spark, [raw], t.safe_long("c")) == [want]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("12", 12.0), (" 1.5 ", 1.5), ("-0.25", -0.25), ("1e3", 1000.0), ("n/a", None), ("", None),
        (None, None), ("12d", None), ("12F", None), ("1,000", None), ("inf", None), ("NaN", None), ("-Infinity", None),
    ],
)
def test_safe_double(spark, raw, want):
    assert values(spark, [raw], t.safe_double("c")) == [want]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026-08-14", dt.date(2026, 8, 14)),
        (" 2026-08-14 ", dt.date(2026, 8, 14)),
        ("2026-8-4", dt.date(2026, 8, 4)),
        ("14/08/2026", dt.date(2026, 8, 14)),
        ("11/07/2026", dt.date(2026, 7, 11)),  # day first, never 7 November
        ("2026-02-30", None),
        ("2026-13-01", None),
        ("08-14-2026", None),
        ("August 14", None),
        ("2026", None),
        ("", None),
        (None, None),
    ],
)
def test_dates_follow_known_formats_only(spark, raw, want):
    assert values(spark, [raw], t.parse_dates("c")) == [want]


def test_the_fast_iso_path_agrees_with_the_pattern(spark):
    df = spark.range(0, 80000, 7).select(F.date_add(F.lit("1950-01-01"), F.col("id").cast("int")).alias("d"))
    text = df.select("d", F.date_format("d", "yyyy-MM-dd").alias("c"))
    same = t.parse_dates("c").eqNullSafe(F.try_to_date("c", t.ISO)) & t.parse_dates("c").eqNullSafe(F.col("d"))
    assert text.filter(~same).count() == 0


def test_non_iso_flag_looks_at_the_raw_shape(spark):
    raw = ["2026-08-14", " 2026-08-14", "2026-8-4", "14/08/2026", None]
    assert values(spark, raw, t.non_iso_flag("c")) == [False, False, True, True, None]


def test_ambiguous_dates_need_two_different_readings(spark):
    raw = ["11/07/2026", "07/07/2026", "14/08/2026", "08/14/2026", "2026-07-11", None]
    got = values(spark, raw, t.is_ambiguous_date("c"))
    assert [bool(v) for v in got] == [True, False, False, False, False, False]


def test_blanks(spark):
    assert values(spark, ["a ", "a", "\ta"], t.has_stray_blanks("c")) == [True, False, True]
    assert values(spark, [None, "", " \t", "a"], t.is_blank("c")) == [True, True, True, False]
