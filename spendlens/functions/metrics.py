"""The metric catalogue: five additive metrics and four ratios of sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.functions.numbers import rounded


@dataclass(frozen=True)
class Metric:
    label: str
    numerator: str
    digits: int
    denominator: str | None = None

    @property
    def is_ratio(self) -> bool:
        return self.denominator is not None

    def total(self) -> Column:
        """The unrounded aggregate. A zero denominator gives NULL, not an error."""
        top = F.sum(self.numerator)
        if self.denominator is None:
            return top
        return top / F.nullif(F.sum(self.denominator), F.lit(0))

    def rounded(self, value: Column | None = None) -> Column:
        value = self.total() if value is None else value
        return rounded(value, self.digits)


# Output name, summed column, decimals, dividing column.
METRICS: dict[str, Metric] = {
    "spend": Metric("spend_usd", "spend_usd", 2),
    "revenue": Metric("revenue_usd", "revenue_usd", 2),
    "conversions": Metric("conversions", "conversions", 0),
    "clicks": Metric("clicks", "clicks", 0),
    "impressions": Metric("impressions", "impressions", 0),
    "roas": Metric("roas", "revenue_usd", 2, "spend_usd"),
    "cpa": Metric("cpa_usd", "spend_usd", 2, "conversions"),
    "ctr": Metric("ctr", "clicks", 4, "impressions"),
    "cpc": Metric("cpc_usd", "spend_usd", 2, "clicks"),
}

# Question wording of a grouping and the fact column behind it.
GROUPINGS: dict[str, str | None] = {
    "channel": "channel",
    "campaign": "campaign_name",
    "creative": "creative_id",
    "objective": "objective",
    "date": "date",
    "none": None,
}


def metric(name: str) -> Metric:
    try:
        return METRICS[name]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; expected one of {sorted(METRICS)}") from None


def grouping_column(name: str) -> str | None:
    try:
        return GROUPINGS[name]
    except KeyError:
        raise ValueError(f"unknown grouping {name!r}; expected one of {sorted(GROUPINGS)}") from None


def metric_expr(name: str) -> Column:
    m = metric(name)
    return m.rounded().alias(m.label)


def roas() -> Column:
    """Return on ad spend of the current group, unrounded."""
    return METRICS["roas"].total()


def roas_tier(value: Column, account: bool = False) -> Column:
    """Traffic light of a ROAS; the account figure has no middle tier."""
    if account:
        return F.when(value >= 1, "green").otherwise("red")
    return F.when(value >= 2, "green").when(value >= 1, "orange").otherwise("red")
