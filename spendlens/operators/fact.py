"""The curated fact: one row per campaign, creative and day, in USD."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.text import norm_code, safe_double, safe_long
from spendlens.operators.clean import clean_campaigns, dated_performance
from spendlens.operators.rates import clean_rates, dense_rates, first_and_last, rates_as_of, span_bounds
from spendlens.functions.numbers import rounded
from spendlens.plans.joins import lookup_join
from spendlens.plans.observed import write_observed
from spendlens.plans.store import drop_folder, new_folder, read_by_month, write_by_month, written
from spendlens.sources.feeds import Feeds

# The columns of the curated fact.
FACT_COLUMNS = [
    "date", "campaign_id", "creative_id", "campaign_name", "channel", "objective",
    "is_running", "impressions", "clicks", "conversions", "spend_local",
    "revenue_local", "currency", "rate_to_usd", "spend_usd", "revenue_usd",
    "is_orphan_campaign", "date_was_non_iso", "rate_was_filled",
    "currency_tag_mismatch", "is_negative_spend", "is_impossible_funnel",
    "revenue_missing",
]
FLAGS = FACT_COLUMNS[16:]


# Report column of each row flag.
FLAG_COUNTS = {
    "date_was_non_iso": "non_iso_dates",
    "is_orphan_campaign": "orphan_rows",
    "currency_tag_mismatch": "currency_mismatches",
    "rate_was_filled": "fx_filled_rows",
    "is_negative_spend": "negative_spend_rows",
    "is_impossible_funnel": "impossible_funnel_rows",
    "revenue_missing": "missing_revenue_rows",
}
assert set(FLAG_COUNTS) == set(FLAGS)


def received_figures() -> dict[str, Column]:
    """Figures over the counted, dated rows of the performance feed."""
    raw = F.coalesce(F.sum("copies"), F.lit(0))
    return {
        "raw_rows": raw,
        "distinct_rows": F.count("*"),
        "duplicates_removed": raw - F.count("*"),
        "unparseable_dates": F.count_if(F.col("day").isNull()),
    }


def fact_figures() -> dict[str, Column]:
    """Figures over the rows of the fact."""
    return {
        **{name: F.count_if(F.col(flag)) for flag, name in FLAG_COUNTS.items()},
        "date_min": F.min("date"),
        "date_max": F.max("date"),
        "total_spend_usd": rounded(F.coalesce(F.sum("spend_usd"), F.lit(0.0)), 2),
        "total_revenue_usd": rounded(F.coalesce(F.sum("revenue_usd"), F.lit(0.0)), 2),
    }


def to_usd(amount: Column | str) -> Column:
    """A local amount at the rate of its own day."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return amount * F.col("rate_to_usd")


def attach_campaigns(
    performance: DataFrame, campaigns: DataFrame, limit: int | None = None
) -> DataFrame:
    """Left join to the campaign dimension; rows of deleted campaigns keep their spend.

    The campaign's currency outranks the tag on the row.
    """
    known = campaigns.select(
        "campaign_id",
        F.col("campaign_name").alias("known_name"),
        F.col("channel").alias("known_channel"),
        F.col("objective").alias("known_objective"),
        F.col("currency").alias("known_currency"),
        "is_running",
        F.lit(True).alias("is_known"),
    )
    joined = lookup_join(performance, known, ["campaign_id"], limit)
    deleted = F.concat(F.lit("(deleted campaign "), "campaign_id", F.lit(")"))
    tag = norm_code("currency")
    known_row = F.coalesce("is_known", F.lit(False))
    return joined.select(
        *[c for c in performance.columns if c != "currency"],
        F.coalesce("known_name", deleted).alias("campaign_name"),
        F.coalesce("known_channel", F.lit("unattributed")).alias("channel"),
        F.coalesce("known_objective", F.lit("unknown")).alias("objective"),
        "is_running",
        F.coalesce("known_currency", tag).alias("currency"),
        (~known_row).alias("is_orphan_campaign"),
        (known_row & ~tag.eqNullSafe(F.col("known_currency"))).alias("currency_tag_mismatch"),
    )


def attach_rates(performance: DataFrame, rates: DataFrame, limit: int | None = None) -> DataFrame:
    """Left join to the rate of each day and resolved currency that occurs."""
    used = rates_as_of(performance.filter(F.col("currency").isNotNull()), rates)
    return lookup_join(performance, used, ["day", "currency"], limit)


def measures(df: DataFrame) -> DataFrame:
    """Typed counts and money, local and converted."""
    typed = df.withColumns(
        {
            **{c: safe_long(c) for c in ("impressions", "clicks", "conversions")},
            "spend_local": safe_double("spend"),
            "revenue_local": safe_double("revenue"),
        }
    )
    return typed.withColumns(
        {"spend_usd": to_usd("spend_local"), "revenue_usd": to_usd("revenue_local")}
    )


def quality_flags(df: DataFrame) -> DataFrame:
    """Row flags that need the typed measures; rows are flagged, never dropped."""
    return df.withColumns(
        {
            "is_negative_spend": F.col("spend_local") < 0,
            "is_impossible_funnel": F.col("clicks") > F.col("impressions"),
            "revenue_missing": F.col("revenue").isNull(),
        }
    )


def assemble(performance: DataFrame, campaigns: DataFrame, rates: DataFrame, limit: int | None = None) -> DataFrame:
    """The fact from dated performance, clean campaigns and published rates."""
    usable = performance.filter(F.col("day").isNotNull()).drop("date")
    rated = attach_rates(attach_campaigns(usable, campaigns, limit), rates, limit)
    return quality_flags(measures(rated)).withColumnRenamed("day", "date").select(*FACT_COLUMNS)


def curated_fact(feeds: Feeds, limit: int | None = None) -> DataFrame:
    """The whole cleaning layer as one lazy frame."""
    performance = dated_performance(feeds["ad_performance_daily"])
    return assemble(performance, clean_campaigns(feeds["campaigns"]), clean_rates(feeds["fx_rates"]), limit)


def write_curated(fact: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write the fact by month and continue from the files."""
    write_by_month(fact, path, mode=mode)
    return read_by_month(fact.sparkSession, path, fact.schema)


@dataclass(frozen=True)
class Curated:
    """Written tables of one run of the cleaning layer."""

    performance: DataFrame  # distinct dated rows with their number of copies
    campaigns: DataFrame
    rates: DataFrame  # as published, typed
    fact: DataFrame
    folder: str
    # Observed when the tables were written: figures of ``received_figures`` and, with ``clean_rows``
    # and the reported ``days``, those of ``fact_figures``.
    received: dict[str, Any] = field(default_factory=dict)
    kept: dict[str, Any] = field(default_factory=dict)

    @property
    def dense(self) -> DataFrame:
        """One row per currency and day of the calendar, from the first day to the last of feed and quotes."""
        return dense_rates(self.rates, *first_and_last(span_bounds(self.performance, self.rates)))

    def drop(self) -> None:
        """Remove the written tables. Frames made from them can't be read after that."""
        drop_folder(self.fact.sparkSession, self.folder)


def build_curated(spark: SparkSession, feeds: Feeds, folder: str | None = None) -> Curated:
    """Run the cleaning layer once and write what later jobs share.

    The raw feed is read a single time: the deduplicated rows are written first,
    so rates, row accounting and the audit come from columnar files. What the quality
    report counts is observed on the way; days are bounded by the calendar.
    """
    folder = folder or new_folder(spark)
    dated_rows = dated_performance(feeds["ad_performance_daily"])
    performance = spark.read.schema(dated_rows.schema)
    target = f"{folder}/performance"
    received = write_observed(
        dated_rows, received_figures(), lambda rows: rows.write.mode("errorifexists").parquet(target), lambda: performance.parquet(target)
    )
    performance = performance.parquet(target)
    campaigns = clean_campaigns(feeds["campaigns"])
    rates = written(clean_rates(feeds["fx_rates"]), f"{folder}/rates")
    fact = assemble(performance, campaigns, rates)
    figures = {"clean_rows": F.count("*"), "days": F.collect_set("date"), **fact_figures()}
    kept = write_by_month(fact, f"{folder}/fact", figures=figures)
    fact = read_by_month(spark, f"{folder}/fact", fact.schema)
    return Curated(performance, campaigns, rates, fact, folder, received, kept)
