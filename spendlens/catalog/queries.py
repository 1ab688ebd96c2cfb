"""Every operator as a named query over the sample feeds of a data folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.metrics import GROUPINGS, METRICS
from spendlens.functions.numbers import rounded
from spendlens.functions.text import (
    non_iso_flag, norm_category, norm_code, norm_label, parse_dates, safe_double, safe_long,
)
from spendlens.operators import aggregates, anomaly, audit, clean, integrity, pause, quality, rates
from spendlens.operators.fact import FACT_COLUMNS, Curated, build_curated
from spendlens.operators.periods import Period, data_span, period_totals, resolve
from spendlens.plans.store import new_folder, written
from spendlens.sources.feeds import Feeds, feed_counts, feed_inventory, malformed_rows, read_feeds
from spendlens.sources.samples import flawed_feeds, sample_feeds, write_as_csv

PERF = "ad_performance_daily"
# Rank and pause windows in which the sample feeds split into every class.
QUARTER = ("quarter_to_date", 0)
PAUSE = ("last_n_days", 120)


class Workspace:
    """Feeds and written tables of one data folder in one session."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[SparkSession, str], Feeds] = sample_feeds):
        self.spark, self.folder, self.make = spark, folder, make
        self.target = new_folder(spark)

    @cached_property
    def flawed(self) -> Workspace:
        """The same for the feeds with the graver defects."""
        return Workspace(self.spark, self.folder, flawed_feeds)

    @cached_property
    def delivered(self) -> Feeds:
        """The sample feeds written as CSV files and read back by name."""
        write_as_csv(self.feeds, f"{self.target}/csv")
        return read_feeds(self.spark, f"{self.target}/csv")

    @cached_property
    def findings(self) -> DataFrame:
        """The audit, with the row counts that the cleaning layer has written."""
        found = audit.audit(self.spark, self.feeds, folder=f"{self.target}/audit", copies=self.curated.performance)
        return written(found, f"{self.target}/findings")

    @cached_property
    def feeds(self) -> Feeds:
        """The sample feeds as files, the state in which a real feed arrives."""
        return {
            name: written(df.hint("rebalance"), f"{self.target}/raw/{name}")
            for name, df in self.make(self.spark, self.folder).items()
        }

    @cached_property
    def curated(self) -> Curated:
        return build_curated(self.spark, self.feeds, self.target)

    @property
    def fact(self) -> DataFrame:
        return self.curated.fact

    @cached_property
    def span(self) -> tuple[dt.date, dt.date]:
        return data_span(self.fact)

    def period(self, kind: str, n: int = 0, **dates) -> Period:
        return resolve(kind, self.span, n, **dates)


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _open:
        _open[key] = Workspace(spark, folder.rstrip("/"))
    return _open[key]


def _safe_casts(w: Workspace) -> DataFrame:
    """Cast results per campaign: parsed and failed values of every measure."""
    perf = w.feeds[PERF]
    longs = ["impressions", "clicks", "conversions"]
    doubles = ["spend", "revenue"]
    return perf.groupBy("campaign_id").agg(
        *[F.sum(safe_long(c)).alias(c) for c in longs],
        *[rounded(F.sum(safe_double(c)), 2).alias(c) for c in doubles],
        *[F.count_if(safe_double(c).isNull()).alias(f"{c}_null") for c in longs + doubles],
    )


def _parsed_dates(w: Workspace) -> DataFrame:
    return w.feeds[PERF].groupBy("date").agg(F.count("*").alias("n_rows")).select(
        F.col("date").alias("date_text"),
        parse_dates("date").alias("day"),
        non_iso_flag("date").alias("non_iso"),
        "n_rows",
    )


def _categories(w: Workspace) -> DataFrame:
    return w.feeds["campaigns"].groupBy(
        norm_category("channel").alias("channel"),
        norm_label("objective").alias("objective"),
        norm_code("currency").alias("currency"),
    ).agg(F.count("*").alias("n_campaigns"), F.count_distinct("channel").alias("spellings"))


def _dedupe_exact(w: Workspace) -> DataFrame:
    return clean.dedupe_exact(w.feeds[PERF]).groupBy("campaign_id").agg(
        F.count("*").alias("n_rows"), F.sum(safe_long("impressions")).alias("impressions")
    )


def _orphan_rows(w: Workspace) -> DataFrame:
    return w.fact.filter("is_orphan_campaign").select(
        "date", "campaign_id", "creative_id", "campaign_name", "channel", "objective", "currency",
        rounded("spend_usd", 2).alias("spend_usd"),
    )


def _currency_resolved(w: Workspace) -> DataFrame:
    return w.fact.groupBy("currency", "currency_tag_mismatch").agg(
        F.count("*").alias("n_rows"), rounded(F.sum("spend_local"), 2).alias("spend_local")
    )


def _share_of_peak(w: Workspace) -> DataFrame:
    return aggregates.share_of_peak(aggregates.aggregate(w.fact, "spend", "channel"), "spend_usd")


def _partial_day_flags(w: Workspace) -> DataFrame:
    return anomaly.flag_partial(anomaly.anomaly(w.fact, "conversions"), "conversions")


def _relevant_caveats(w: Workspace) -> DataFrame:
    return quality.relevant_caveats(
        quality.quality_report(w.curated), w.fact, "roas", "channel", w.period(*PAUSE)
    )


def _per_feed(w: Workspace, check: Callable[[DataFrame, str], DataFrame], feeds: Feeds | None = None) -> DataFrame:
    out = None
    for name, df in (w.feeds if feeds is None else feeds).items():
        part = check(df, name)
        out = part if out is None else out.unionByName(part)
    return out


def _date_checks(w: Workspace) -> DataFrame:
    out = None
    for name, column in audit.DATE_COLUMNS.items():
        part = audit.date_check(w.feeds[name], column, name)
        out = part if out is None else out.unionByName(part)
    return out


def _result_diff(w: Workspace) -> DataFrame:
    """Rows per day before and after cleaning."""
    raw = w.feeds[PERF].groupBy(parse_dates("date").alias("date")).agg(F.count("*").alias("n_rows"))
    kept = w.fact.groupBy("date").agg(F.count("*").alias("n_rows"))
    return integrity.result_diff(raw, kept)


def _changed_cells(w: Workspace) -> DataFrame:
    """Rows and impressions per day before and after cleaning, cell by cell."""
    raw = w.feeds[PERF].groupBy(parse_dates("date").alias("date")).agg(
        F.count("*").alias("n_rows"), F.sum(safe_long("impressions")).alias("impressions")
    )
    kept = w.fact.groupBy("date").agg(F.count("*").alias("n_rows"), F.sum("impressions").alias("impressions"))
    return integrity.changed_cells(raw, kept, ["date"])


def _malformed(w: Workspace) -> DataFrame:
    return _per_feed(w, lambda df, name: df.agg(
        F.count("*").alias("n_rows"), malformed_rows(df).alias("malformed_rows"), F.count_distinct(df.columns[0]).alias("keys"),
    ).select(F.lit(name).alias("feed"), "*"), w.delivered)


def _without(w: Workspace, feed: str, column: str | None = None) -> DataFrame:
    """The audit of an incomplete delivery."""
    feeds = {k: v for k, v in w.feeds.items() if k != feed}
    if column:
        feeds[feed] = w.feeds[feed].drop(column)
    return audit.audit(w.spark, feeds, copies=w.curated.performance)


def _volume(w: Workspace) -> DataFrame:
    return audit.daily_volume(w.feeds[PERF])


def _catalog() -> dict[str, Callable[[Workspace], DataFrame]]:
    perf = lambda w: w.feeds[PERF]
    q: dict[str, Callable[[Workspace], DataFrame]] = {
        # Sources
        "feed_counts": lambda w: feed_counts(w.feeds),
        "feed_inventory": lambda w: feed_inventory(w.flawed.feeds),
        "csv_feed_counts": lambda w: feed_counts({k: v for k, v in w.delivered.items() if k != "fx_rates"}),
        "csv_malformed": _malformed,
        # Cleaning
        "clean_campaigns": lambda w: clean.clean_campaigns(w.feeds["campaigns"]),
        "norm_categories": _categories,
        "safe_casts": _safe_casts,
        "parsed_dates": _parsed_dates,
        "dedupe_exact": _dedupe_exact,
        "clean_rates": lambda w: rates.clean_rates(w.feeds["fx_rates"]),
        "flag_counts": lambda w: quality.flag_counts(w.fact),
        # Calendar and rates
        "span_bounds": lambda w: rates.span_bounds(w.curated.performance, w.curated.rates),
        "calendar": lambda w: rates.calendar(rates.span_bounds(w.fact, day="date"), "date"),
        "fx_dense": lambda w: w.curated.dense,
        "missing_days": lambda w: quality.missing_days(w.fact),
        "fx_gaps": lambda w: audit.feed_gaps(w.feeds["fx_rates"]),
        # Joins
        "curated_fact": lambda w: w.fact.select(*FACT_COLUMNS),
        "orphan_rows": _orphan_rows,
        "currency_resolved": _currency_resolved,
        "referential": lambda w: audit.referential(w.feeds),
        "fx_missing_pairs": lambda w: audit.missing_pairs(
            perf(w), w.feeds["fx_rates"], audit.RATE_GRAIN
        ),
        "currency_mismatch": lambda w: audit.attr_mismatch(
            perf(w), w.feeds["campaigns"], "campaign_id", "currency"
        ),
        "unrated_rows": lambda w: quality.unrated_rows(w.flawed.fact),
        "conflicting_rates": lambda w: rates.conflicting_keys(w.flawed.curated.rates),
        # Periods
        "period_clamped": lambda w: period_totals(
            w.fact,
            w.period("explicit", start=dt.date(1990, 1, 1), end=dt.date(2030, 12, 31)),
        ),
        # Metrics
        "spend_by_channel_8_weeks": lambda w: aggregates.aggregate(
            w.fact, "spend", "channel", w.period("last_n_weeks", 8)
        ),
        "ctr_without_impossible_rows": lambda w: aggregates.aggregate(
            w.fact, "ctr", "channel", exclude_impossible=True
        ),
        "daily_spend": lambda w: aggregates.aggregate(w.fact, "spend", "date"),
        "kpis": lambda w: aggregates.kpis(w.fact),
        "campaign_roas": lambda w: aggregates.campaign_roas(w.fact),
        "scorecard": lambda w: aggregates.scorecard(w.fact),
        "fx_impact": lambda w: aggregates.fx_impact(w.fact),
        "daily_volume": _volume,
        # Rankings
        "rank_revenue_by_campaign": lambda w: aggregates.rank(
            w.fact, "revenue", "campaign", w.period(*QUARTER), aggregates.ranking_size(3)[0]
        ),
        "rank_limit_100": lambda w: aggregates.rank(w.fact, "impressions", "creative", limit=100),
        "rank_spend_by_date": lambda w: aggregates.rank(w.fact, "spend", "date"),
        "rank_worst_cpc_by_creative": lambda w: aggregates.rank(
            w.fact, "cpc", "creative", limit=20, ascending=True
        ),
        "rank_flip": lambda w: aggregates.rank_flip(w.fact, w.period(*QUARTER)),
        "leader_runner_up": lambda w: aggregates.leader(w.fact, "revenue", "campaign"),
        "roas_top10": lambda w: aggregates.campaign_roas(w.fact, 10),
        # Shares, tiers, movement
        "spend_share": lambda w: aggregates.share_of_total(w.fact, "channel"),
        "spend_share_by_creative": lambda w: aggregates.share_of_total(w.fact, "creative"),
        "share_of_peak": _share_of_peak,
        "roas_tiers": lambda w: aggregates.roas_tiers(w.fact),
        "partial_day_flags": _partial_day_flags,
        "last_day_check": lambda w: anomaly.last_day_check(w.fact, w.span[1]),
        "last_day_ratios": lambda w: anomaly.last_day_ratios(_volume(w)),
        "anomaly_conversions_by_campaign": lambda w: anomaly.anomaly(w.fact, "conversions", by="campaign"),
        "anomaly_spend_by_channel": lambda w: anomaly.anomaly(w.fact, "spend", by="channel"),
        "anomaly_most_recent_day": lambda w: anomaly.anomaly(w.fact, "conversions", w.period("most_recent_day")),
        # Pause decision
        "pause_scorecard": lambda w: pause.pause_scorecard(w.fact, w.period(*PAUSE)),
        "pause_scorecard_all_time": lambda w: pause.pause_scorecard(w.fact, min_conv=600),
        "pause_pick": lambda w: pause.pause_pick(w.fact, w.period(*PAUSE)),
        "pause_traps": lambda w: pause.pause_traps(w.fact, w.period(*PAUSE)),
        # Quality report
        "row_accounting": lambda w: quality.accounting(w.curated),
        "quality_report": lambda w: quality.quality_report(w.curated),
        "caveats": lambda w: quality.caveats(quality.quality_report(w.curated)),
        "relevant_caveats": _relevant_caveats,
        # Audit
        "profile": lambda w: _per_feed(w, audit.profile),
        "dup_rows": lambda w: _per_feed(w, audit.dup_rows),
        "grain_violations": lambda w: audit.grain(perf(w), audit.PERFORMANCE_GRAIN),
        "grain_summary": lambda w: _per_feed(
            w, lambda df, name: audit.grain_summary(df, audit.GRAIN[name], name)
        ),
        "grain_sample": lambda w: audit.grain_sample(perf(w), audit.PERFORMANCE_GRAIN),
        "date_check": _date_checks,
        "date_offenders": lambda w: audit.date_offenders(perf(w), "date"),
        "ambiguous_dates": lambda w: audit.ambiguous_dates(perf(w), "date"),
        "currency_mix": lambda w: audit.value_counts(perf(w), "currency"),
        "base_rate_check": lambda w: audit.base_rate_check(w.flawed.feeds["fx_rates"]),
        "fx_dup_keys": lambda w: audit.dup_keys(w.feeds["fx_rates"], audit.RATE_GRAIN),
        "stray_dates": lambda w: audit.stray_dates(_volume(w.flawed)),
        "audit_missing_days": lambda w: audit.audit_missing_days(_volume(w)),
        "numeric_summary": lambda w: audit.numeric_summary(perf(w)),
        "non_numeric": lambda w: audit.non_numeric(perf(w.flawed)),
        "impossible_values": lambda w: audit.impossible_values(perf(w)),
        "zero_denoms": lambda w: audit.zero_denoms(perf(w)),
        "vocabulary": lambda w: audit.vocabulary(w.feeds),
        "campaign_windows": lambda w: audit.window_check(perf(w), w.feeds["campaigns"]),
        "budget_check": lambda w: audit.budget_check(w.feeds["campaigns"]),
        "audit_findings": lambda w: audit.audit(w.spark, w.feeds, copies=w.curated.performance),
        "audit_severities": lambda w: audit.severity_counts(w.findings),
        "audit_missing_feed": lambda w: _without(w, "creatives"),
        "audit_missing_column": lambda w: _without(w, "creatives", "headline"),
        # The feeds with the graver defects
        "flawed_safe_casts": lambda w: _safe_casts(w.flawed),
        "flawed_row_accounting": lambda w: quality.row_accounting(w.flawed.curated.performance, w.flawed.fact),
        "flawed_flag_counts": lambda w: quality.flag_counts(w.flawed.fact),
        "flawed_date_offenders": lambda w: audit.date_offenders(perf(w.flawed), "date"),
        "flawed_impossible_values": lambda w: audit.impossible_values(perf(w.flawed)),
        "flawed_campaign_windows": lambda w: audit.window_check(perf(w.flawed), w.flawed.feeds["campaigns"]),
        "flawed_audit_missing_days": lambda w: audit.audit_missing_days(_volume(w.flawed)),
        # Integrity
        "parts_sum_to_total": lambda w: integrity.parts_sum_to_total(w.fact),
        "ratio_bounds": lambda w: integrity.ratio_bounds(w.fact, "creative"),
        "row_density": lambda w: integrity.row_density(w.fact),
        "result_diff": _result_diff,
        "changed_cells": _changed_cells,
    }
    for name in METRICS:
        for group in GROUPINGS:
            key = f"agg_{name}" if group == "none" else f"agg_{name}_by_{group}"
            q[key] = lambda w, name=name, group=group: aggregates.aggregate(w.fact, name, group)
        q[f"anomaly_{name}"] = lambda w, name=name: anomaly.anomaly(w.fact, name)
    for kind, n in PERIODS.items():
        dates = EXPLICIT if kind == "explicit" else {}
        q[f"period_{kind}"] = lambda w, kind=kind, n=n, dates=dates: period_totals(
            w.fact, w.period(kind, n, **dates)
        )
    return q


PERIODS = {
    "last_n_days": 7, "last_n_weeks": 8, "last_n_months": 3, "quarter_to_date": 0,
    "month_to_date": 0, "most_recent_day": 0, "all_time": 0, "explicit": 0,
}
EXPLICIT = {"start": dt.date(1999, 1, 1), "end": dt.date(2000, 6, 30)}


def catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, folder: query(workspace(spark, folder))

    return {key: bind(query) for key, query in _catalog().items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Spend by channel over the last eight weeks."""
    return catalog()["spend_by_channel_8_weeks"](spark, folder)
