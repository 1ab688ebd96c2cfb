"""What the cleaning layer did, and the caveats that go with an answer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.functions.metrics import grouping_column, metric
from spendlens.functions.numbers import rounded
from spendlens.operators.anomaly import SUSPECT_SHARE, last_day_check
from spendlens.operators.fact import Curated, fact_figures, received_figures
from spendlens.operators.periods import Period

def row_accounting(performance: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows received, kept and lost; ``performance`` is the counted, dated feed.

    Unreadable dates are counted as such, so a join that fans out cannot hide them.
    """
    clean = fact.agg(F.count("*")).scalar()
    return performance.agg(*_aliased(received_figures())).withColumn("clean_rows", clean)


def accounting(curated: Curated) -> DataFrame:
    """``row_accounting`` of a run of the cleaning layer, from what was observed when it wrote its tables."""
    if not curated.received:
        return row_accounting(curated.performance, curated.fact)
    figures = {**curated.received, "clean_rows": curated.kept["clean_rows"]}
    return _one_row(curated.fact.sparkSession, {name: ("bigint", n) for name, n in figures.items()})


def _one_row(spark: SparkSession, values: dict[str, tuple[str, object]]) -> DataFrame:
    return spark.range(1).select(*[F.lit(value).cast(kind).alias(name) for name, (kind, value) in values.items()])


def _aliased(figures: dict[str, Column]) -> list[Column]:
    return [figure.alias(name) for name, figure in figures.items()]


def flag_counts(fact: DataFrame) -> DataFrame:
    """Flag counts, span and totals in one pass."""
    return fact.agg(*_aliased(fact_figures()))


def missing_days(df: DataFrame, day: str = "date") -> DataFrame:
    """Days of the covered span on which no row falls.

    Each reported day unfolds the gap up to the next one, so the rows are read once;
    the window runs over one row per calendar day.
    """
    days = df.filter(F.col(day).isNotNull()).select(F.col(day).alias("date")).distinct()
    following = F.lead("date").over(Window.orderBy("date"))
    gaps = days.withColumn("next", following).filter(F.datediff("next", "date") > 1)
    return gaps.select(
        F.explode(F.sequence(F.date_add("date", 1), F.date_sub("next", 1))).alias("date")
    )


def unrated_rows(fact: DataFrame) -> DataFrame:
    """Rows without an exchange rate, whose money silently adds nothing."""
    return fact.agg(
        F.count_if(F.col("rate_to_usd").isNull()).alias("unrated_rows"),
        rounded(
            F.coalesce(F.sum(F.when(F.col("rate_to_usd").isNull(), F.col("spend_local"))), F.lit(0.0)), 2
        ).alias("unrated_spend_local"),
    )


def quality_report(curated: Curated) -> DataFrame:
    """The whole report in one row, from the figures that were observed when the tables were written."""
    if curated.received:
        return _observed_report(curated)
    counts = curated.fact.agg(F.count("*").alias("clean_rows"), *_aliased(fact_figures()))
    received = curated.performance.agg(F.struct(*_aliased(received_figures()))).scalar()
    # At most one entry per calendar day, so the list is bounded by the span.
    gaps = missing_days(curated.fact).agg(
        F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ", ").alias("days"),
        F.count("*").alias("n"),
    )
    gap = gaps.select(F.struct("days", "n")).scalar()
    return counts.select(
        *[received[n].alias(n) for n in ("raw_rows", "duplicates_removed", "unparseable_dates")],
        *counts.columns,
        gap["n"].alias("n_missing_days"),
        gap["days"].alias("missing_days"),
    )


def _observed_report(curated: Curated) -> DataFrame:
    days = sorted(curated.kept["days"] or [])
    missing = [
        (before + dt.timedelta(days=i)).isoformat()
        for before, after in zip(days, days[1:])  # noqa: B905
        for i in range(1, (after - before).days)
    ]
    kinds = {"date_min": "date", "date_max": "date", "total_spend_usd": "double", "total_revenue_usd": "double"}
    figures = {name: n for name, n in curated.received.items() if name != "distinct_rows"}
    figures |= {name: n for name, n in curated.kept.items() if name != "days"}
    values = {name: (kinds.get(name, "bigint"), n) for name, n in figures.items()}
    values |= {"n_missing_days": ("bigint", len(missing)), "missing_days": ("string", ", ".join(missing))}
    return _one_row(curated.fact.sparkSession, values)


# What each count in the report means to a reader, in reading order.
CAVEATS: list[tuple[str, str]] = [
    ("duplicates_removed", "duplicate rows were removed before summing"),
    ("non_iso_dates", "dates were not ISO and were read day first"),
    ("orphan_rows", "rows belong to an unknown campaign and count as unattributed"),
    ("currency_mismatches", "rows carried another currency than their campaign, which was used"),
    ("fx_filled_rows", "rows fall on days without a published rate and use the last known one"),
    ("n_missing_days", "days have no rows at all, which affects averages"),
    ("missing_revenue_rows", "rows have no revenue and are left out of revenue, not counted as zero"),
    ("impossible_funnel_rows", "rows report more clicks than impressions"),
    ("negative_spend_rows", "rows carry negative spend, real credits that are kept"),
]


def caveats(report: DataFrame) -> DataFrame:
    """One row for every caveat that applies, with the number behind it."""
    codes = [code for code, _ in CAVEATS]
    text = F.lit(None).cast("string")
    for code, sentence in CAVEATS:
        text = F.when(F.col("code") == code, F.lit(sentence)).otherwise(text)
    return (
        report.select(codes)
        .unpivot([], codes, "code", "n")
        .filter(F.col("n") > 0)
        .select("code", "n", text.alias("caveat"))
    )


MONEY = {"spend", "revenue", "roas", "cpa", "cpc"}


def relevant_codes(name: str, group_by: str) -> list[str]:
    """Caveats that bear on one metric and grouping."""
    metric(name), grouping_column(group_by)
    rules = {
        "duplicates_removed": True,
        "fx_filled_rows": name in MONEY,
        "missing_revenue_rows": name in ("revenue", "roas"),
        "impossible_funnel_rows": name in ("ctr", "cpc"),
        "orphan_rows": group_by == "channel",
    }
    return [code for code, applies in rules.items() if applies]


def relevant_caveats(
    report: DataFrame, fact: DataFrame, name: str, group_by: str, period: Period
) -> DataFrame:
    """Only the caveats that bear on one answer, dated ones inside its period.

    The last day is called partial when it is far below the days before it, not
    merely because the period ends on it.
    """
    general = caveats(report).filter(F.col("code").isin(relevant_codes(name, group_by))).select(
        "code", "n", F.lit(None).cast("date").alias("date"), "caveat"
    )
    gaps = (
        missing_days(fact)
        .filter(F.col("date").between(F.lit(period.lo), F.lit(period.hi)))
        .select(
            F.lit("missing_day").alias("code"),
            F.lit(1).cast("bigint").alias("n"),
            "date",
            F.lit("no data was reported on this day").alias("caveat"),
        )
    )
    low = F.col("n_rows") < SUSPECT_SHARE * F.col("median_rows")
    partial = (
        last_day_check(fact)
        .filter(low & (F.col("last_day") == F.lit(period.hi)))
        .select(
            F.lit("partial_last_day").alias("code"),
            "n_rows",
            "last_day",
            F.lit("the last day holds far fewer rows than usual, treat it as partial").alias("caveat"),
        )
    )
    return general.unionByName(gaps).union(partial)
