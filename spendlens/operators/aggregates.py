"""Totals, breakdowns, rankings and shares over the curated fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.metrics import grouping_column, metric, metric_expr, roas, roas_tier
from spendlens.functions.numbers import rounded
from spendlens.operators.periods import Period, in_period

RANK_DEFAULT, RANK_FLOOR, RANK_CAP = 10, 5, 50


def _scope(fact: DataFrame, period: Period | None, exclude_impossible: bool) -> DataFrame:
    rows = in_period(fact, period)
    if exclude_impossible:
        rows = rows.filter(~F.coalesce("is_impossible_funnel", F.lit(False)))
    return rows


def _grouped(
    fact: DataFrame,
    name: str,
    group_by: str,
    period: Period | None,
    exclude_impossible: bool = False,
    by_id: bool = False,
) -> tuple[DataFrame, list[str]]:
    column = grouping_column(group_by)
    keys = [] if column is None else [column]
    if by_id and group_by == "campaign":
        keys = ["campaign_id", *keys]
    exprs = [metric_expr(name)]
    if metric(name).is_ratio:
        # Volume beside a ratio, so one built on two conversions shows as such.
        exprs.append(metric_expr("spend"))
        exprs.append(F.sum("conversions").alias("conversions"))
    return _scope(fact, period, exclude_impossible).groupBy(*keys).agg(*exprs), keys


def _ordered(keys: list[str], label: str, ascending: bool = False) -> list[Column]:
    value = F.col(label)
    first = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return [first, *[F.col(k).asc() for k in keys]]


def aggregate(
    fact: DataFrame,
    name: str,
    group_by: str = "none",
    period: Period | None = None,
    exclude_impossible: bool = False,
    by_id: bool = False,
) -> DataFrame:
    """A metric in total or per group: best group first, dates in order.

    Campaigns group by their name, so equal names merge unless ``by_id``.
    """
    out, keys = _grouped(fact, name, group_by, period, exclude_impossible, by_id)
    if not keys:
        return out
    if group_by == "date":
        return out.orderBy("date")
    return out.orderBy(*_ordered(keys, metric(name).label))


def ranking_size(asked: int, floor: int = RANK_FLOOR, cap: int = RANK_CAP) -> tuple[int, str | None]:
    """A readable number of rows for a ranking, and a warning when it is not the one asked for."""
    rows = RANK_DEFAULT if asked <= 0 else min(max(asked, floor), cap)
    if asked <= 0 or rows == asked:
        return rows, None
    return rows, f"{asked} rows were asked for and {rows} are shown (from {floor} to {cap})"


def rank(
    fact: DataFrame,
    name: str,
    group_by: str,
    period: Period | None = None,
    limit: int = 0,
    ascending: bool = False,
) -> DataFrame:
    """The best ``limit`` groups by a metric, ten unless asked.

    Ranked by the metric for every grouping, dates included. A caller that shows
    rankings to people may pass its limit through ``ranking_size`` first.
    """
    if grouping_column(group_by) is None:
        raise ValueError("a ranking needs a grouping")
    rows = RANK_DEFAULT if limit <= 0 else limit
    out, keys = _grouped(fact, name, group_by, period)
    return out.orderBy(*_ordered(keys, metric(name).label, ascending)).limit(rows)


def kpis(fact: DataFrame) -> DataFrame:
    """The account in one row.

    Summed per campaign and channel first: counting two different columns
    distinctly over the raw rows would triple them before the shuffle.
    """
    sums = ["spend_usd", "revenue_usd", "conversions", "clicks", "impressions"]
    per_campaign = fact.groupBy("campaign_id", "channel").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )
    return per_campaign.agg(
        rounded(F.sum("spend_usd"), 2).alias("total_spend"),
        rounded(F.sum("revenue_usd"), 2).alias("total_revenue"),
        F.sum("conversions").alias("total_conversions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        rounded(roas(), 2).alias("overall_roas"),
        F.count_distinct("campaign_id").alias("campaigns"),
        F.count_distinct("channel").alias("channels"),
        F.min("first_day").alias("date_from"),
        F.max("last_day").alias("date_to"),
    )


def campaign_roas(fact: DataFrame, top: int | None = None) -> DataFrame:
    """ROAS board of known campaigns; ``top`` keeps the best with a ROAS."""
    board = (
        fact.filter(~F.col("is_orphan_campaign"))
        .groupBy("campaign_name", "objective")
        .agg(rounded(roas(), 2).alias("roas"), rounded(F.sum("spend_usd"), 0).alias("spend"))
    )
    order = _ordered(["campaign_name", "objective"], "roas")
    if top is None:
        return board.orderBy(*order)
    return board.filter(F.col("roas").isNotNull()).orderBy(*order).limit(top)


def scorecard(fact: DataFrame) -> DataFrame:
    """Lifetime figures per known campaign; no ROAS without positive spend."""
    spend, revenue = F.sum("spend_usd"), F.sum("revenue_usd")
    return (
        fact.filter(~F.col("is_orphan_campaign"))
        .groupBy("campaign_id", "campaign_name", "objective", "is_running")
        .agg(
            F.count_distinct("date").alias("days"),
            rounded(spend, 0).alias("spend"),
            rounded(revenue, 0).alias("revenue"),
            F.sum("conversions").alias("conversions"),
            F.when(spend > 0, rounded(F.try_divide(revenue, spend), 2)).alias("roas"),
        )
        .orderBy(F.col("roas").asc_nulls_last(), "campaign_id")
    )


def fx_impact(fact: DataFrame) -> DataFrame:
    """Spend summed over mixed currencies against spend converted per day."""
    totals = fact.agg(F.sum("spend_local").alias("naive"), F.sum("spend_usd").alias("converted"))
    return totals.unpivot([], ["naive", "converted"], "method", "total").select(
        "method", rounded("total", 2).alias("total")
    )


def rank_flip(fact: DataFrame, period: Period | None = None, places: int = 3) -> DataFrame:
    """Leading campaigns by raw and by converted revenue, and whether the winner differs.

    Both rankings come from one aggregate. The filter on the row number lets each
    task keep only its own leaders before anything is gathered.
    """
    totals = (
        in_period(fact, period)
        .groupBy("campaign_id", "campaign_name")
        .agg(
            F.sum("revenue_local").alias("naive"),
            F.sum("revenue_usd").alias("converted"),
        )
    )
    ranked = totals.unpivot(
        ["campaign_id", "campaign_name"], ["naive", "converted"], "method", "amount"
    ).filter(F.col("amount").isNotNull())
    order = Window.partitionBy("method").orderBy(F.col("amount").desc(), "campaign_id")
    leaders = ranked.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= places
    )
    winner = F.when(F.col("position") == 1, F.col("campaign_id"))
    whole = Window.partitionBy(F.lit(0))
    return leaders.select(
        "method",
        F.col("position").cast("bigint").alias("position"),
        "campaign_id",
        "campaign_name",
        rounded("amount", 2).alias("revenue"),
        (F.min(winner).over(whole) != F.max(winner).over(whole)).alias("winner_flips"),
    ).orderBy("method", "position")


def leader(fact: DataFrame, name: str, group_by: str, period: Period | None = None) -> DataFrame:
    """The first two groups of a breakdown and how many groups there are."""
    out, keys = _grouped(fact, name, group_by, period)
    if not keys:
        raise ValueError("a leader needs a grouping")
    label = metric(name).label
    # The peak rides along so that both branches read the same shuffle.
    groups = out.agg(F.struct(F.max(label).alias("peak"), F.count("*").alias("n"))).scalar()
    top = out.orderBy(*_ordered(keys, label)).limit(2)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_ordered(keys, label)))
    return top.select(
        place.cast("bigint").alias("position"),
        F.col(keys[-1]).alias("group_value"),
        F.col(label).alias("metric_value"),
        groups["n"].alias("n_groups"),
    )


def share_of_total(fact: DataFrame, group_by: str = "channel", period: Period | None = None) -> DataFrame:
    """Spend per group with its share of the whole."""
    column = grouping_column(group_by)
    sums = in_period(fact, period).groupBy(column).agg(F.sum("spend_usd").alias("spend"))
    whole = sums.agg(F.sum("spend")).scalar()
    return sums.select(
        column,
        rounded("spend", 2).alias("spend_usd"),
        rounded(F.try_divide(100 * F.col("spend"), whole), 1).alias("pct"),
    ).orderBy(F.col("spend_usd").desc_nulls_last(), column)


def share_of_peak(df: DataFrame, value: str) -> DataFrame:
    """Adds each row's value as a percentage of the largest one."""
    peak = df.agg(F.max(value)).scalar()
    return df.withColumn(
        "pct_of_peak", rounded(F.try_divide(100 * F.col(value), peak), 1)
    )


def roas_tiers(fact: DataFrame) -> DataFrame:
    """The ROAS board with its traffic lights, the whole account's included."""
    account = fact.agg(rounded(roas(), 2).alias("roas")).select(
        F.lit("(account)").alias("campaign_name"),
        F.lit("(all)").alias("objective"),
        "roas",
        roas_tier(F.col("roas"), account=True).alias("tier"),
    )
    return campaign_roas(fact).select(
        "campaign_name", "objective", "roas", roas_tier(F.col("roas")).alias("tier")
    ).unionByName(account)
