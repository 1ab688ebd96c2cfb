"""Small literal feeds, one row or more per defect class."""

from __future__ import annotations

PERF_COLUMNS = [
    "date", "campaign_id", "creative_id", "impressions", "clicks", "conversions", "spend",
    "revenue", "currency",
]
CAMPAIGN_COLUMNS = [
    "campaign_id", "campaign_name", "channel", "objective", "currency", "daily_budget",
    "start_date", "end_date",
]
CREATIVE_COLUMNS = ["creative_id", "campaign_id", "creative_name", "format", "headline", "launched_on"]
RATE_COLUMNS = ["date", "currency", "rate_to_usd"]

CAMPAIGNS = [
    ("C1", "Search India", "google_search", "conversions", "INR", "1500.0", "2026-06-01", None),
    ("C2", "Search US", "Google Search ", "conversions", "USD", "200", "2026-06-01", None),
    ("C3", "Old Sale", "Meta ", "conversions", "INR", "0", "2026-06-01", "2026-06-10"),
    ("C4", "Video Reach", "YouTube", "Awareness", "usd", None, "2026-06-01", None),
    ("C5", "Never Ran", "linkedin", "traffic", "USD", "10", "2026-06-20", "2026-06-15"),
]
CREATIVES = [
    ("K1", "C1", "one", "video", "Buy now, save", "2026-06-01"),
    ("K2", "C2", "two", "image", "Plain", "2026-06-01"),
    ("K4", "C9", "four", "image ", "Lost", "2026-06-01"),
]
# Friday, Monday; nothing on the weekend in between, Monday delivered twice.
RATES = [
    ("2026-06-05", "INR", "0.012"),
    ("2026-06-08", "INR", "0.010"),
    ("2026-06-08", "INR", "0.010"),
    ("2026-06-05", "USD", "1.0"),
    ("2026-06-08", "USD", "1.0"),
]
PERF = [
    ("2026-06-05", "C1", "K1", "1000", "100", "5", "1000", "2000", "INR"),
    ("2026-06-06", "C1", "K1", "1000", "100", "5", "1000", "2000", "INR"),  # Saturday
    ("2026-06-06", "C1", "K1", "1000", "100", "5", "1000", "2000", "INR"),  # exact copy
    ("08/06/2026", "C1", "K1", "1000", "100", "5", "1000", None, "INR"),  # day first, no revenue
    ("2026-06-08", "C2", "K2", "500", "600", "0", "50", "0", "USD"),  # more clicks than impressions
    ("2026-06-08", "C2", "K3", "500", "10", "2", "-5", "30", "USD"),  # credit, unknown creative
    ("2026-06-08", "C3", "K1", "10", "1", "1", "100", "500", "USD"),  # tagged against its campaign
    ("2026-06-08", "C4", "K2", "9000", "90", "0", "20", "1", "USD"),
    ("2026-06-08", "C99", "K2", "10", "1", "0", "3", "1", " usd"),  # deleted campaign
    ("June 8", "C1", "K1", "10", "1", "0", "3", "1", "INR"),  # no known format
    ("2026-06-05", "C2", "K2", "12.0", "abc", "1e1", "n/a", "7", "USD"),  # odd numbers
]


def literal_feeds(spark, perf=None, campaigns=None, creatives=None, rates=None):
    def frame(rows, columns):
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))

    return {
        "ad_performance_daily": frame(PERF if perf is None else perf, PERF_COLUMNS),
        "campaigns": frame(CAMPAIGNS if campaigns is None else campaigns, CAMPAIGN_COLUMNS),
        "creatives": frame(CREATIVES if creatives is None else creatives, CREATIVE_COLUMNS),
        "fx_rates": frame(RATES if rates is None else rates, RATE_COLUMNS),
    }


def fact_frame(spark, rows):
    """A curated-like frame from dicts; unnamed columns get plain defaults."""
    import datetime as dt

    from pyspark.sql import types as T

    defaults = {
        "date": dt.date(2026, 6, 1), "campaign_id": "C1", "creative_id": "K1",
        "campaign_name": None, "channel": "meta", "objective": "conversions", "is_running": True,
        "impressions": 100, "clicks": 10, "conversions": 1, "spend_local": 1.0,
        "revenue_local": 1.0, "spend_usd": 1.0, "revenue_usd": 1.0, "rate_to_usd": 1.0,
        "is_orphan_campaign": False, "is_impossible_funnel": False,
    }
    schema = T.StructType(
        [
            T.StructField(
                name,
                T.DateType() if name == "date"
                else T.BooleanType() if name.startswith("is_")
                else T.LongType() if name in ("impressions", "clicks", "conversions")
                else T.DoubleType() if name.endswith(("_usd", "_local"))
                else T.StringType(),
            )
            for name in defaults
        ]
    )
    full = []
    for row in rows:
        merged = {**defaults, **row}
        if merged["campaign_name"] is None:
            merged["campaign_name"] = "name " + str(merged["campaign_id"])
        full.append(tuple(merged[f.name] for f in schema.fields))
    return spark.createDataFrame(full, schema)
