"""Audit of the raw feeds, sharing no parsing rule with the cleaning layer.

It reads slash dates month first, as a general-purpose parser would, which is how
day-first dates give themselves away as strays. Checks over the performance feed
take an optional ``weight`` column, so they run on the raw rows as well as on the
summary that ``audit`` writes once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.functions.numbers import rounded
from spendlens.functions.text import (
    DAY_FIRST, ISO, MONTH_FIRST, has_stray_blanks, is_ambiguous_date, is_blank, non_iso_flag,
    parse_dates, safe_double,
)
from spendlens.operators.anomaly import last_day_ratios
from spendlens.operators.quality import missing_days
from spendlens.plans.observed import write_observed
from spendlens.plans.quantiles import bucket_counts, exact_quantiles, plain_figures
from spendlens.plans.store import new_folder, written
from spendlens.sources.feeds import EXPECTED, MALFORMED, Feeds, data_columns, malformed_rows

PERFORMANCE = "ad_performance_daily"
# Which of the documented columns are keys, numbers, dates and categories.
KEY_COLUMNS = ["date", "campaign_id", "creative_id", "currency", "rate_to_usd"]
NUMERIC = ["impressions", "clicks", "conversions", "spend", "revenue"]
DENOMINATORS = ["spend", "impressions", "conversions"]
PERFORMANCE_GRAIN = ["date", "campaign_id", "creative_id"]
RATE_GRAIN = ["date", "currency"]
GRAIN = {
    "ad_performance_daily": PERFORMANCE_GRAIN,
    "campaigns": ["campaign_id"],
    "creatives": ["creative_id"],
    "fx_rates": RATE_GRAIN,
}
DATE_COLUMNS = {
    "ad_performance_daily": "date", "campaigns": "start_date", "creatives": "launched_on",
}
# The documented vocabularies.
VOCABULARY = {
    "channel": ["google_search", "meta", "youtube", "linkedin"],
    "objective": ["conversions", "traffic", "awareness"],
    "currency": ["INR", "USD"],
}
CATEGORIES = ["channel", "objective", "currency", "format"]
SEVERITIES = ["BLOCKER", "HIGH", "MEDIUM", "INFO"]
FINDING = ["check", "target", "severity", "n_rows", "detail"]


def naive_date(c: Column | str) -> Column:
    """A date as a parser without a format list reads it: slash dates month first."""
    return parse_dates(c, (ISO, MONTH_FIRST, DAY_FIRST))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def has(feeds: Feeds, feed: str, *columns: str) -> bool:
    """Whether a feed is there with these columns."""
    return feed in feeds and all(c in feeds[feed].columns for c in columns)


def _rows(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def _number(df: DataFrame, name: str) -> Column:
    return safe_double(name) if dict(df.dtypes)[name] == "string" else F.col(name)


# Profiles ------------------------------------------------------------------


def profile(df: DataFrame, feed: str, approx: bool = False) -> DataFrame:
    """Nulls, blanks, distinct values and the first value per column.

    All but the distinct values come from one plain aggregate. Those of all columns are
    counted in one more pass: (column, 128 bits of the value) is made distinct in the
    tasks first, and only such triples are shuffled, however wide the texts are.
    ``approx`` takes them from the aggregate as well, within two percent.
    """
    columns = data_columns(df)
    figures = {c: {
        "nulls": F.count_if(F.col(c).isNull()), "blanks": F.count_if(is_blank(c)), "sample": F.min(c),
        "distinct_values": F.approx_count_distinct(c, 0.02) if approx else F.lit(0),
    } for c in columns}
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.struct(*[v.alias(k) for k, v in own.items()]).alias(f"of_{i}") for i, own in enumerate(figures.values())],
    )
    tagged = []
    for i, c in enumerate(columns):
        own = F.col(f"of_{i}")
        grave = F.lit("HIGH" if c in KEY_COLUMNS else "MEDIUM")
        tagged.append(F.struct(
            F.lit(c).alias("column"), own["nulls"].alias("nulls"),
            rounded(100 * F.try_divide(own["nulls"], F.col("rows")), 2).alias("null_pct"),
            own["blanks"].alias("blanks"), own["distinct_values"].cast("bigint").alias("distinct_values"), own["sample"].alias("sample"),
            F.when(own["nulls"] > 0, grave).alias("severity"),
        ))
    rows = row.select(F.lit(feed).alias("feed"), F.inline(F.array(*tagged)))
    if approx:
        return rows
    counted = rows.drop("distinct_values").join(_distinct_values(df, columns), "column", "left")
    return counted.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0))).select(*rows.columns)


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, distinct_values`` of columns with any value, from one pass and one narrow shuffle."""
    named = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("of"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit("again"), c).alias("b")))
        for i, c in enumerate(columns)
    ]
    values = df.select(F.explode(F.array(*named)).alias("v")).filter("v is not null").select("v.*").distinct()
    names = F.array(*[F.lit(c) for c in columns])
    return values.groupBy(F.element_at(names, F.col("of") + 1).alias("column")).agg(F.count("*").alias("distinct_values"))


# Duplicates and grain ------------------------------------------------------


def dup_rows(df: DataFrame, feed: str) -> DataFrame:
    """Extra copies of fully identical rows."""
    copies = df.groupBy(*data_columns(df)).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
        F.count_if(F.col("n") > 1).alias("repeated_rows"),
    ).select(F.lit(feed).alias("feed"), "extra_rows", "repeated_rows")


def grain(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Keys that several rows share."""
    return df.groupBy(*keys).agg(_rows(weight).alias("n_rows")).filter(F.col("n_rows") > 1)


def grain_summary(df: DataFrame, keys: list[str], feed: str, weight: str | None = None) -> DataFrame:
    return grain(df, keys, weight).agg(
        F.count("*").alias("colliding_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("colliding_rows"),
    ).select(F.lit(feed).alias("feed"), "colliding_keys", "colliding_rows")


def grain_sample(df: DataFrame, keys: list[str], size: int = 12) -> DataFrame:
    """The first ``size`` rows that share a key, for a reader to look at; ``grain_summary`` counts them all.

    ``size`` keys hold at least ``size`` rows, so no more keys are ever looked up.
    """
    shared = grain(df, keys).orderBy(*keys).limit(size)
    meets = None
    for k in keys:
        same = df[k].eqNullSafe(shared[k])
        meets = same if meets is None else meets & same
    return df.join(F.broadcast(shared), meets, "left_semi").orderBy(*df.columns).limit(size)


def dup_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return grain(df, keys).agg(
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("extra_rows"),
        F.count("*").alias("repeated_keys"),
    )


# Dates ---------------------------------------------------------------------


def date_check(df: DataFrame, column: str, feed: str) -> DataFrame:
    """Range, unreadable values and values that are not in ISO form.

    Equal texts are counted first, so each is parsed once and not once per row.
    """
    texts = df.groupBy(column).agg(F.count("*").alias("n"))
    raw, parsed = F.col(column), naive_date(column)
    odd = non_iso_flag(column)
    return texts.agg(
        F.min(parsed).alias("first_day"),
        F.max(parsed).alias("last_day"),
        F.coalesce(F.sum(F.when(parsed.isNull() & raw.isNotNull(), F.col("n"))), F.lit(0)).alias("unparseable"),
        F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0)).alias("non_iso"),
        F.count_distinct(F.when(odd, F.trim(raw))).alias("non_iso_values"),
    ).select(F.lit(feed).alias("feed"), F.lit(column).alias("column"), "*")


def date_offenders(df: DataFrame, column: str) -> DataFrame:
    """The distinct date texts that are not in ISO form, and whether they can be read at all."""
    return (
        df.filter(non_iso_flag(column))
        .groupBy(F.trim(column).alias("text"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("readable", parse_dates("text").isNotNull())
    )


def ambiguous_dates(df: DataFrame, column: str) -> DataFrame:
    """Slash dates that read as two different days."""
    return (
        df.filter(is_ambiguous_date(column))
        .groupBy(F.trim(column).alias("text"))
        .agg(F.count("*").alias("n_rows"))
        .select(
            "text",
            F.try_to_date("text", DAY_FIRST).alias("day_first"),
            F.try_to_date("text", MONTH_FIRST).alias("month_first"),
            "n_rows",
        )
    )


# References between feeds ---------------------------------------------------


def unmatched(a: DataFrame, b: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks, with the rows they carry."""
    used = a.filter(F.col(key).isNotNull()).groupBy(key).agg(_rows(weight).alias("n_rows"))
    return used.join(b.select(key).distinct(), key, "left_anti")


def referential(feeds: Feeds) -> DataFrame:
    """Unmatched ids in all four directions, those between feeds that are there."""
    directions = [
        ("performance without campaign", PERFORMANCE, "campaigns", "campaign_id"),
        ("campaign without performance", "campaigns", PERFORMANCE, "campaign_id"),
        ("performance without creative", PERFORMANCE, "creatives", "creative_id"),
        ("creative without campaign", "creatives", "campaigns", "campaign_id"),
    ]
    parts = [
        unmatched(feeds[a], feeds[b], key).select(F.lit(name).alias("direction"), F.col(key).alias("id"), "n_rows")
        for name, a, b, key in directions
        if has(feeds, a, key) and has(feeds, b, key)
    ]
    if not parts:
        raise ValueError("no two feeds share a key")
    return _union(parts)


def attr_mismatch(
    a: DataFrame, b: DataFrame, key: str, column: str, weight: str | None = None
) -> DataFrame:
    """Rows whose attribute differs from their dimension's, both being set.

    Rows are counted per key and value first, so the join sees no hot key.
    """
    rows = (
        a.filter(F.col(key).isNotNull() & F.col(column).isNotNull())
        .groupBy(key, F.col(column).alias("row_value"))
        .agg(_rows(weight).alias("n_rows"))
    )
    known = b.select(key, F.col(column).alias("known_value"))
    return rows.join(known, key).filter(F.col("row_value") != F.col("known_value"))


def missing_pairs(need: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations in use that the other feed does not supply."""
    return need.select(*keys).dropna().distinct().join(have.select(*keys).distinct(), keys, "left_anti")


def value_counts(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(column).agg(_rows(weight).alias("n_rows"))


# Rates ---------------------------------------------------------------------


def feed_gaps(feed: DataFrame, key: str = "currency") -> DataFrame:
    """Rows, value range and calendar days without a row per key."""
    typed = feed.select(key, naive_date("date").alias("day"), safe_double("rate_to_usd").alias("v"))
    per_key = typed.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.min("v").alias("min_rate"),
        F.max("v").alias("max_rate"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_distinct("day").alias("days"),
    )
    span = F.datediff("last_day", "first_day") + 1
    return per_key.select(
        key, "n_rows", "min_rate", "max_rate", "first_day", "last_day",
        (span - F.col("days")).cast("bigint").alias("calendar_gaps"),
    )


def base_rate_check(feed: DataFrame, base: str = "USD") -> DataFrame:
    """Rates of the base currency that are not one."""
    off = F.abs(safe_double("rate_to_usd") - 1)
    return feed.filter(F.col("currency") == base).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce(off >= 1e-9, F.lit(True))).alias("off_rows"),
    ).select(F.lit(base).alias("currency"), "n_rows", "off_rows")


# Volume --------------------------------------------------------------------


def daily_volume(perf: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows, active campaigns and sums per day as the audit reads dates.

    Summed per raw date text and campaign first: dates are then parsed once per
    text, and counting campaigns needs no distinct aggregate over the rows.
    """
    sums = ["impressions", "conversions", "spend"]
    per_text = perf.groupBy("date", "campaign_id").agg(
        _rows(weight).alias("n"), *[F.sum(_number(perf, c)).alias(c) for c in sums]
    )
    per_campaign = (
        per_text.withColumn("day", naive_date("date"))
        .filter(F.col("day").isNotNull())
        .groupBy("day", "campaign_id")
        .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    )
    return per_campaign.groupBy(F.col("day").alias("date")).agg(
        F.sum("n").alias("n_rows"),
        F.count("campaign_id").alias("campaigns"),
        F.coalesce(F.sum("impressions"), F.lit(0.0)).cast("bigint").alias("impressions"),
        F.coalesce(F.sum("conversions"), F.lit(0.0)).cast("bigint").alias("conversions"),
        rounded(F.coalesce(F.sum("spend"), F.lit(0.0)), 2).alias("spend"),
    )


def stray_dates(daily: DataFrame, reach: float = 0.25) -> DataFrame:
    """Days far outside the span that holds the middle 96 percent of reported days."""
    return daily.filter(is_stray(daily, reach)).select("date", "n_rows")


def is_stray(daily: DataFrame, reach: float = 0.25) -> Column:
    number = F.unix_date("date")
    ends = daily.agg(F.percentile(number, F.array(F.lit(0.02), F.lit(0.98)))).scalar()
    low, high = ends[0], ends[1]
    margin = (high - low) * reach
    return (number < low - margin) | (number > high + margin)


def audit_missing_days(daily: DataFrame) -> DataFrame:
    """Days without rows once strays are set aside."""
    return missing_days(daily.join(stray_dates(daily), "date", "left_anti"))


# Values --------------------------------------------------------------------


def numeric_summary(perf: DataFrame) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles per numeric column.

    One scan counts buckets of the values; the plain figures are added up from them and the
    quartiles read again only the values of the few ranges that hold one.
    """
    numbers = perf.select(*[_number(perf, c).alias(c) for c in NUMERIC])
    long = numbers.unpivot([], NUMERIC, "column", "value")
    counts = written(bucket_counts(long, "column", "value"), f"{new_folder(perf.sparkSession)}/buckets")
    quartiles = exact_quantiles(long, "column", "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, counts)
    both = plain_figures(counts, "column").join(quartiles, "column")
    names = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return both.select("column", "n", *[rounded(c, 4).alias(c) for c in names])


def non_numeric(perf: DataFrame, examples: int = 5) -> DataFrame:
    """Text that is no number in each numeric column: the count, and the first ``examples`` texts in order.

    Text for "not a number" and for infinities is among them.
    """
    bad = (
        perf.unpivot([], NUMERIC, "column", "text")
        .filter(F.col("text").isNotNull() & safe_double("text").isNull())
        .groupBy("column", "text")
        .agg(F.count("*").alias("n"))
    )
    counted = bad.groupBy("column").agg(F.sum("n").alias("n_bad"))
    order = Window.partitionBy("column").orderBy("text")
    shown = (
        bad.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= examples)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias("examples"))
    )
    names = F.explode(F.array(*[F.lit(c) for c in NUMERIC])).alias("column")
    every = perf.sparkSession.range(1).select(names)
    return (
        every.join(counted, "column", "left")
        .join(shown, "column", "left")
        .select("column", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), "examples")
    )


@dataclass(frozen=True)
class Rule:
    check: str
    target: str
    severity: str
    detail: str
    broken: Column


def rule_counts(df: DataFrame, rules: list[Rule], weight: str | None = None, once: frozenset | set = frozenset()) -> DataFrame:
    """How many rows break each rule, all rules in one pass. Checks in ``once`` don't count the first of equal rows."""
    each = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    if not rules:
        raise ValueError("no rules given")
    tagged = [
        F.struct(
            F.lit(r.check).alias("check"),
            F.lit(r.target).alias("target"),
            F.lit(r.severity).alias("severity"),
            F.col(f"broken_{i}").alias("n_rows"),
            F.lit(r.detail).alias("detail"),
        )
        for i, r in enumerate(rules)
    ]
    counted = df.agg(
        *[
            F.coalesce(F.sum(F.when(r.broken, each - 1 if r.check in once else each)), F.lit(0)).alias(f"broken_{i}")
            for i, r in enumerate(rules)
        ]
    )
    return counted.select(F.inline(F.array(*tagged)))


def _parsed(name: str) -> Column:
    return F.col(f"{name}_number")


def with_numbers(perf: DataFrame) -> DataFrame:
    """Adds each measure as a number, parsed once for however many rules use it."""
    return perf.withColumns({f"{c}_number": _number(perf, c) for c in NUMERIC if c in perf.columns})


def impossible_rules(target: str = "ad_performance_daily") -> list[Rule]:
    """The eight combinations no real row can show.

    The rules read the columns of ``with_numbers``.
    """
    n = {c: _parsed(c) for c in NUMERIC}
    conditions = {
        "negative spend": n["spend"] < 0,
        "negative revenue": n["revenue"] < 0,
        "negative conversions": n["conversions"] < 0,
        "clicks > impressions": n["clicks"] > n["impressions"],
        "conversions > clicks": n["conversions"] > n["clicks"],
        "spend > 0 with 0 impressions": (n["spend"] > 0) & (n["impressions"] == 0),
        "revenue > 0 with 0 conversions": (n["revenue"] > 0) & (n["conversions"] == 0),
        "non-integer impressions": n["impressions"] % 1 != 0,
    }
    return [
        Rule("impossible value", target, "HIGH" if "negative" in name else "MEDIUM", name, broken)
        for name, broken in conditions.items()
    ]


def impossible_values(perf: DataFrame) -> DataFrame:
    return rule_counts(with_numbers(perf), impossible_rules()).select(
        F.col("detail").alias("rule"), "severity", "n_rows"
    )


def zero_denoms(perf: DataFrame) -> DataFrame:
    """Rows whose own ratios would divide by zero."""
    counts = perf.agg(*[F.count_if(_number(perf, c) == 0).alias(c) for c in DENOMINATORS])
    return counts.unpivot([], DENOMINATORS, "column", "zero_rows")


def vocabulary(feeds: Feeds, expected: dict[str, list[str]] | None = None) -> DataFrame:
    """Value counts of every category column that is there, marked against the documented values."""
    expected = VOCABULARY if expected is None else expected
    parts = []
    for feed in ("campaigns", "creatives"):
        columns = [c for c in CATEGORIES if has(feeds, feed, c)]
        if columns:
            long = feeds[feed].unpivot([], columns, "column", "value").groupBy("column", "value")
            parts.append(long.agg(F.count("*").alias("n_rows")).select(F.lit(feed).alias("feed"), "*"))
    if not parts:
        raise ValueError("no feed has a category column")
    known = F.lit(None).cast("boolean")
    for column, values in expected.items():
        known = F.when(F.col("column") == column, F.col("value").isin(values)).otherwise(known)
    return _union(parts).withColumns(
        {
            "is_expected": F.when(F.col("value").isNotNull(), known),
            "has_stray_blanks": F.coalesce(has_stray_blanks("value"), F.lit(False)),
        }
    )


# Campaigns -----------------------------------------------------------------


def _windows(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        "campaign_id",
        naive_date("start_date").alias("starts"),
        naive_date("end_date").alias("ends"),
        F.col("end_date").isNull().alias("open_ended"),
    )


def outside_window(perf: DataFrame, campaigns: DataFrame, weight: str | None = None) -> DataFrame:
    """Performance rows dated before their campaign starts or after it ends."""
    days = perf.groupBy("campaign_id", "date").agg(_rows(weight).alias("n_rows"))
    dated = days.withColumn("day", naive_date("date")).join(_windows(campaigns), "campaign_id")
    before, after = F.col("day") < F.col("starts"), F.col("day") > F.col("ends")
    return dated.agg(
        F.coalesce(F.sum(F.when(before, F.col("n_rows"))), F.lit(0)).alias("rows_before_start"),
        F.coalesce(F.sum(F.when(after, F.col("n_rows"))), F.lit(0)).alias("rows_after_end"),
    )


def window_check(perf: DataFrame, campaigns: DataFrame, weight: str | None = None) -> DataFrame:
    """Campaign windows: ranges, reversed ones and performance outside them."""
    outside = outside_window(perf, campaigns, weight).select(
        F.struct("rows_before_start", "rows_after_end")
    ).scalar()
    return _windows(campaigns).agg(
        F.count("*").alias("campaigns"),
        F.count_if("open_ended").alias("still_running"),
        F.count_if(F.col("ends") < F.col("starts")).alias("reversed_windows"),
        F.min("starts").alias("first_start"),
        F.max("starts").alias("last_start"),
        F.min("ends").alias("first_end"),
        F.max("ends").alias("last_end"),
    ).select(
        "*",
        outside["rows_before_start"].alias("rows_before_start"),
        outside["rows_after_end"].alias("rows_after_end"),
    )


def budget_check(campaigns: DataFrame) -> DataFrame:
    budget = safe_double("daily_budget")
    return campaigns.agg(
        F.count_if(budget.isNull()).alias("null_budgets"),
        F.min(budget).alias("min_budget"),
        F.max(budget).alias("max_budget"),
        F.count_if(budget <= 0).alias("non_positive"),
    )


# Roll-up -------------------------------------------------------------------

SUMMARY_KEYS = ["date", "campaign_id", "currency"]
SUMMARY_SUMS = ["impressions", "conversions", "spend"]


def summarise(copies: DataFrame) -> DataFrame:
    """Counted performance rows per raw date, campaign and currency; what is not there is left out."""
    keys = [c for c in SUMMARY_KEYS if c in copies.columns]
    return copies.groupBy(*keys).agg(*[v.alias(k) for k, v in summary_sums(copies).items()])


def summary_sums(copies: DataFrame) -> dict[str, Column]:
    sums = [c for c in SUMMARY_SUMS if c in copies.columns]
    return {
        "n_raw": F.sum("copies"),
        **{c: F.coalesce(F.sum(safe_double(c) * F.col("copies")), F.lit(0.0)) for c in sums},
    }


def _feed_rules(feed: str, columns: list[str], expected: dict[str, list[str]] | None = None) -> list[Rule]:
    """Everything about one feed that a row shows by itself, as far as its columns are there."""

    def there(*names: str) -> bool:
        return all(n in columns for n in names)

    rules = [
        Rule(
            "nulls", f"{feed}.{c}", "HIGH" if c in KEY_COLUMNS else "MEDIUM",
            "empty values", F.col(c).isNull(),
        )
        for c in EXPECTED[feed]
        if there(c)
    ]
    if feed in DATE_COLUMNS and there(DATE_COLUMNS[feed]):
        column = DATE_COLUMNS[feed]
        target, raw = f"{feed}.{column}", F.col(column)
        rules += [
            Rule("unparseable date", target, "HIGH", "no known date format",
                 naive_date(column).isNull() & raw.isNotNull()),
            Rule("non-ISO date", target, "HIGH", "mixed formats land in the wrong month",
                 non_iso_flag(column)),
        ]
    if feed == PERFORMANCE:
        rules += [
            Rule("non-numeric", f"{feed}.{c}", "HIGH", "text in a numeric column",
                 F.col(c).isNotNull() & _parsed(c).isNull())
            for c in NUMERIC
            if there(c)
        ]
        rules += [r for r in impossible_rules(feed) if there(*(c for c in NUMERIC if c in r.detail))]
        rules += [
            Rule("zero denominator", f"{feed}.{c}", "INFO", "a ratio of this row has no value",
                 _parsed(c) == 0)
            for c in DENOMINATORS
            if there(c)
        ]
    if feed == "campaigns" and there("start_date", "end_date"):
        rules.append(Rule("reversed window", feed, "HIGH", "ends before it starts",
                          naive_date("end_date") < naive_date("start_date")))
    if feed == "campaigns" and there("daily_budget"):
        rules.append(Rule("budget", f"{feed}.daily_budget", "MEDIUM", "not positive",
                          safe_double("daily_budget") <= 0))
    if feed == "fx_rates" and there("currency", "rate_to_usd"):
        off = F.coalesce(F.abs(safe_double("rate_to_usd") - 1) >= 1e-9, F.lit(True))
        rules.append(Rule("base rate", f"{feed}.rate_to_usd", "MEDIUM", "USD rate is not one",
                          (F.col("currency") == "USD") & off))
    if feed in ("campaigns", "creatives"):
        known = VOCABULARY if expected is None else expected
        for c in (c for c in CATEGORIES if there(c)):
            if c in known:
                rules.append(Rule("unexpected values", f"{feed}.{c}", "MEDIUM", "outside the documented set", ~F.col(c).isin(known[c])))
            rules.append(Rule("stray blanks", f"{feed}.{c}", "MEDIUM", "whitespace around a category", has_stray_blanks(c)))
    return rules


def _finding(df: DataFrame, check: str, target: Column | str, severity: str, n: Column, detail: Column | str) -> DataFrame:
    target = F.lit(target) if isinstance(target, str) else target
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        F.lit(check).alias("check"),
        target.alias("target"),
        F.lit(severity).alias("severity"),
        n.cast("bigint").alias("n_rows"),
        detail.alias("detail"),
    )


def drift(spark: SparkSession, feeds: Feeds) -> DataFrame | None:
    """Feeds and columns that are not as documented."""
    rows = []
    for feed, wanted in EXPECTED.items():
        present = data_columns(feeds[feed]) if feed in feeds else []
        lacking = [c for c in wanted if c not in present]
        extra = [c for c in present if c not in wanted]
        if feed not in feeds:
            rows.append(("missing feed", feed, "BLOCKER", 1, "its checks are left out"))
        elif lacking:
            rows.append(("missing columns", feed, "BLOCKER", len(lacking), ", ".join(lacking)))
        if extra:
            rows.append(("extra columns", feed, "INFO", len(extra), ", ".join(extra)))
    schema = "check string, target string, severity string, n_rows bigint, detail string"
    return spark.createDataFrame(rows, schema) if rows else None


def _against_campaigns(summary: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Rows of unknown campaigns, in another currency, and outside their window, from one join.

    Grouped by campaign, currency and day the summary meets each campaign once, and
    a campaign delivered twice is counted for each delivery, as a plain join would.
    """
    wanted = [c for c in ("currency", "start_date", "end_date") if c in campaigns.columns]
    known = campaigns.select("campaign_id", F.lit(True).alias("is_known"), *[F.col(c).alias(f"known_{c}") for c in wanted])
    rows = summary.filter(F.col("campaign_id").isNotNull()).join(known, "campaign_id", "left")
    tests = {"orphan": F.col("is_known").isNull()}
    if "currency" in wanted and "currency" in summary.columns:
        tests["mismatch"] = F.col("currency") != F.col("known_currency")
    if "date" in summary.columns and len(wanted) > 1 and "start_date" in wanted and "end_date" in wanted:
        day = naive_date("date")
        tests["outside"] = (day < naive_date("known_start_date")) | (day > naive_date("known_end_date"))
    names = {
        "orphan": ("orphan campaigns", "HIGH", "rows an inner join would drop", "campaign_id"),
        "mismatch": ("currency mismatch", "HIGH", "row and campaign disagree", "campaign_id"),
        "outside": ("outside window", "MEDIUM", "rows outside their campaign window", "campaign_id"),
    }
    per_id = rows.groupBy("campaign_id").agg(
        *[F.coalesce(F.sum(F.when(t, F.col("n_raw"))), F.lit(0)).alias(k) for k, t in tests.items()]
    )
    sums = per_id.agg(*[F.struct(F.sum(k).alias("n"), F.count_if(F.col(k) > 0).alias("ids")).alias(k) for k in tests])
    findings = F.array(*[
        F.struct(F.lit(names[k][0]).alias("check"), F.lit(PERFORMANCE).alias("target"), F.lit(names[k][1]).alias("severity"),
                 F.col(f"{k}.n").cast("bigint").alias("n_rows"),
                 F.concat(F.lit(names[k][2] + ", "), F.col(f"{k}.ids").cast("string"), F.lit(" ids")).alias("detail"))
        for k in tests
    ])
    return sums.select(F.inline(findings))


def _broken_rows(rules: list[Rule]) -> dict[str, Column]:
    """Rows that break each rule, of rows with their number of ``copies``."""
    return {f"broken_{i}": F.coalesce(F.sum(F.when(r.broken, F.col("copies"))), F.lit(0)) for i, r in enumerate(rules)}


def _observed_rules(rules: list[Rule], found: dict) -> list[tuple]:
    return [(r.check, r.target, r.severity, found[f"broken_{i}"], r.detail) for i, r in enumerate(rules)]


def _extra_copies() -> Column:
    return F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))


def _counted_feed(df: DataFrame, feed: str, rules: list[Rule], path: str) -> tuple[DataFrame, list[tuple]]:
    """A feed as its different rows with their copies, written once, and what was observed on the way.

    Malformed rows, rows that break a rule and copies of rows are counted by the job that writes.
    """
    columns, malformed = data_columns(df), MALFORMED in df.columns
    broken = F.count(F.col(MALFORMED)) if malformed else F.lit(0).cast("bigint")
    counted = df.groupBy(*columns).agg(F.count("*").alias("copies"), broken.alias("_malformed"))
    figures = {**_broken_rows(rules), "extra": _extra_copies(), "malformed": F.coalesce(F.sum("_malformed"), F.lit(0))}
    back = df.sparkSession.read.schema(counted.schema)
    found = write_observed(counted, figures, lambda rows: rows.write.parquet(path), lambda: back.parquet(path))
    rows = [*_observed_rules(rules, found), ("duplicate rows", feed, "HIGH", found["extra"], DUPLICATES)]
    if malformed:
        rows.append(("malformed rows", feed, "HIGH", found["malformed"], NOT_AS_HEADER))
    return back.parquet(path).drop("_malformed"), rows


def _summary_and_rules(copies: DataFrame, rules: list[Rule], path: str) -> tuple[DataFrame, dict]:
    """``summarise``, written, and the rows that break each rule: summed beside it, and observed as it is written.

    So one scan of the counted rows serves both. The sums by rule are not kept.
    """
    keys = [c for c in SUMMARY_KEYS if c in copies.columns]
    kept = summary_sums(copies)
    per_rule = _broken_rows(rules)
    wide = with_numbers(copies).groupBy(*keys).agg(
        *[v.alias(k) for k, v in {**kept, **per_rule, "extra": _extra_copies()}.items()]
    )
    figures = {k: F.coalesce(F.sum(k), F.lit(0)) for k in (*per_rule, "extra")}
    columns = [*keys, *kept]
    back = copies.sparkSession.read.schema(wide.select(*columns).schema)
    found = write_observed(
        wide, figures, lambda rows: rows.select(*columns).write.parquet(path), lambda: copies.sparkSession.read.parquet(path)
    ) if rules else {}
    return back.parquet(path), found


def _rows_by_creative(copies: DataFrame, path: str) -> tuple[DataFrame | None, int | None]:
    """Rows of each creative, written, and rows that share the grain with others, from one scan of the counted rows."""
    keys = [c for c in PERFORMANCE_GRAIN if c in copies.columns]
    if "creative_id" not in keys:
        return None, None
    per_key = copies.groupBy(*keys).agg(F.sum("copies").alias("n"))
    rows = per_key.groupBy("creative_id").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared")
    )
    back = copies.sparkSession.read.schema(rows.schema)
    figures = {"shared": F.coalesce(F.sum("shared"), F.lit(0))}
    found = write_observed(rows, figures, lambda r: r.write.parquet(path), lambda: back.parquet(path))
    return back.parquet(path), found["shared"] if len(keys) == len(PERFORMANCE_GRAIN) else None


def _volume_with_strays(summary: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``daily_volume`` with ``stray`` for days far outside, written, and the rows of such days."""
    volume = daily_volume(summary, "n_raw")
    rows = volume.withColumn("stray", F.coalesce(is_stray(volume), F.lit(False)))
    back = summary.sparkSession.read.schema(rows.schema)
    figures = {"n": F.coalesce(F.sum(F.when(F.col("stray"), F.col("n_rows"))), F.lit(0))}
    found = write_observed(rows, figures, lambda r: r.write.parquet(path), lambda: back.parquet(path))
    return back.parquet(path), found["n"]


def _met(keys: list[str], sides: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows that each side has of every key, from one pass over the union of the sides."""
    parts = [
        df.select(*keys, *[(F.col(weight) if own == name else F.lit(None)).cast("bigint").alias(own) for own in sides])
        for name, (df, weight) in sides.items()
    ]
    return _union(parts).groupBy(*keys).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sides])


def _keyed(met: DataFrame, findings: list[tuple[str, str, str, Column, Column | str]]) -> DataFrame:
    """Findings (check, target, severity, aggregate over the keys, detail) from one aggregate over ``_met``."""
    sums = met.agg(*[n.cast("bigint").alias(f"n_{i}") for i, (_, _, _, n, _) in enumerate(findings)],
                   *[d.alias(f"d_{i}") for i, (*_, d) in enumerate(findings) if isinstance(d, Column)])
    rows = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(target).alias("target"), F.lit(severity).alias("severity"),
                 F.col(f"n_{i}").alias("n_rows"), (F.col(f"d_{i}") if isinstance(d, Column) else F.lit(d)).alias("detail"))
        for i, (check, target, severity, _, d) in enumerate(findings)
    ])
    return sums.select(F.inline(rows))


def _shared_rows(name: str) -> Column:
    return F.sum(F.when(F.col(name) > 1, F.col(name)))


def _grain_detail(feed: str) -> str:
    return "rows share " + ", ".join(GRAIN[feed])


DUPLICATES = "identical rows count twice in every sum"
NOT_AS_HEADER = "rows do not have as many fields as their header"
FINDING = "check string, target string, severity string, n_rows bigint, detail string"


def audit(spark: SparkSession, feeds: Feeds, expected: dict[str, list[str]] | None = None,
          folder: str | None = None, copies: DataFrame | None = None) -> DataFrame:
    """All findings, gravest first.

    Every check stands alone: where a feed or a column is missing, that is a
    finding, and only the checks that need it are left out.

    Each feed is read once, to count identical rows; ``copies`` may hand over those of
    the performance feed when the cleaning layer has written them already. All that a
    row shows by itself is observed by the jobs that write: the counted rows of the small
    feeds, a summary of performance by day, campaign and currency, and its rows by
    creative. What is left to do are comparisons of keys over these tables.
    """
    parts = [p for p in [drift(spark, feeds)] if p is not None]
    rows: list[tuple] = []
    folder = folder or f"{new_folder(spark)}/audit"
    feeds = {feed: df for feed, df in feeds.items() if feed in EXPECTED}
    counted: Feeds = {}
    for feed, df in feeds.items():
        columns = data_columns(df)
        if feed != PERFORMANCE or copies is None:
            # The rules of performance wait for its summary, so that numbers are parsed once.
            rules = [] if feed == PERFORMANCE else _feed_rules(feed, columns, expected)
            counted[feed], found = _counted_feed(df, feed, rules, f"{folder}/{feed}")
            rows += found
        else:
            counted[feed] = copies.select(*columns, "copies")
            if MALFORMED in df.columns:
                n = df.agg(malformed_rows(df)).first()[0]
                rows.append(("malformed rows", feed, "HIGH", n, NOT_AS_HEADER))

    summary = by_creative = None
    if PERFORMANCE in feeds:
        own = counted[PERFORMANCE]
        rules = _feed_rules(PERFORMANCE, data_columns(feeds[PERFORMANCE]))
        summary, found = _summary_and_rules(own, rules, f"{folder}/summary")
        rows += _observed_rules(rules, found)
        if copies is not None:
            rows.append(("duplicate rows", PERFORMANCE, "HIGH", found.get("extra", 0), DUPLICATES))
        by_creative, shared = _rows_by_creative(own, f"{folder}/creatives_in_use")
        if shared is not None:
            rows.append(("grain", PERFORMANCE, "HIGH", shared, _grain_detail(PERFORMANCE)))

    campaigns = counted.get("campaigns") if has(feeds, "campaigns", "campaign_id") else None
    creatives = counted.get("creatives")
    known = F.col("campaign_id").isNotNull()
    sides, checks = {}, []
    if campaigns is not None:
        sides["in_campaigns"] = (campaigns, "copies")
        checks.append(("grain", "campaigns", "HIGH", _shared_rows("in_campaigns"), _grain_detail("campaigns")))
        if summary is not None and "campaign_id" in summary.columns:
            parts.append(_against_campaigns(summary, campaigns.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))))
            sides["in_performance"] = (summary, "n_raw")
            checks.append(("unused campaigns", "campaigns", "INFO",
                           F.count_if(known & (F.col("in_campaigns") > 0) & (F.col("in_performance") == 0)), "campaigns without performance"))
        if has(feeds, "creatives", "campaign_id"):
            sides["in_creatives"] = (creatives, "copies")
            checks.append(("unknown campaigns", "creatives", "MEDIUM",
                           F.count_if(known & (F.col("in_creatives") > 0) & (F.col("in_campaigns") == 0)), "campaigns only creatives know"))
        parts.append(_keyed(_met(["campaign_id"], sides), checks))
    if has(feeds, "creatives", "creative_id"):
        sides = {"in_creatives": (creatives, "copies")}
        checks = [("grain", "creatives", "HIGH", _shared_rows("in_creatives"), _grain_detail("creatives"))]
        if by_creative is not None:
            sides["in_use"] = (by_creative, "n_rows")
            lost = F.col("creative_id").isNotNull() & (F.col("in_use") > 0) & (F.col("in_creatives") == 0)
            ids = F.concat(F.lit("rows without a creative, "), F.count_if(lost).cast("string"), F.lit(" ids"))
            checks.append(("orphan creatives", PERFORMANCE, "MEDIUM", F.sum(F.when(lost, F.col("in_use"))), ids))
        parts.append(_keyed(_met(["creative_id"], sides), checks))
    if has(feeds, "fx_rates", *RATE_GRAIN):
        fx = counted["fx_rates"]
        sides = {"in_rates": (fx, "copies")}
        checks = [
            ("grain", "fx_rates", "HIGH", _shared_rows("in_rates"), _grain_detail("fx_rates")),
            ("duplicate rate keys", "fx_rates", "HIGH", F.sum(F.when(F.col("in_rates") > 1, F.col("in_rates") - 1)),
             "the rate join fans out"),
        ]
        if summary is not None and all(c in summary.columns for c in RATE_GRAIN):
            sides["in_performance"] = (summary, "n_raw")
            unmet = (F.col("in_performance") > 0) & (F.col("in_rates") == 0)
            for key in RATE_GRAIN:
                unmet = unmet & F.col(key).isNotNull()
            checks.append(("missing rates", "fx_rates", "HIGH", F.count_if(unmet), "day and currency pairs without a rate"))
        parts.append(_keyed(_met(RATE_GRAIN, sides), checks))
        if "rate_to_usd" in fx.columns:
            parts.append(_finding(feed_gaps(fx), "rate gaps", F.concat(F.lit("fx_rates."), "currency"), "HIGH",
                                  F.col("calendar_gaps"), "calendar days without a rate"))
    if summary is not None and all(c in summary.columns for c in ["date", "campaign_id", *SUMMARY_SUMS]):
        volume, strays = _volume_with_strays(summary, f"{folder}/volume")
        rows.append(("stray dates", PERFORMANCE, "HIGH", strays, "rows dated far outside the extract"))
        gaps = missing_days(volume.filter(~F.col("stray"))).agg(F.count("*").alias("n"))
        parts += [
            _finding(last_day_ratios(volume).filter("looks_partial"), "partial last day",
                     F.concat(F.lit(PERFORMANCE + "."), "measure"), "HIGH", F.lit(1),
                     "last day far below the 14 days before"),
            _finding(gaps, "missing days", PERFORMANCE, "MEDIUM", F.col("n"), "days without rows"),
        ]
    found_rows = [row for row in rows if row[3]]
    if found_rows:
        parts.append(spark.createDataFrame(found_rows, FINDING))
    if not parts:
        return spark.createDataFrame([], FINDING)
    weight = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return _union(parts).filter(F.col("n_rows") > 0).orderBy(weight, "check", "target", "detail")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity, of findings already made."""
    return findings.groupBy("severity").agg(F.count("*").alias("n_findings"))
