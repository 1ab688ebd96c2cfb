"""Messy ad feeds derived from the star-schema test tables.

Order lines play performance rows, suppliers campaigns, parts creatives and
regions currencies. Defects are planted by arithmetic on column values, so the
same rows come out on any engine and at any size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.sources.feeds import Feeds

PARTIAL_DAY = dt.date(2001, 11, 4)
OUTAGE = [dt.date(2001, 10, 1), dt.date(2001, 10, 2)]
TWICE_DELIVERED = "2001-08-06"
ISO_TEXT = "yyyy-MM-dd"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _currency() -> Column:
    return F.when(F.col("r_regionkey") == 1, "USD").otherwise(
        F.upper(F.substring("r_name", 1, 3))
    )


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    return (
        _table(spark, folder, "supplier")
        .join(nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    )


def _performance(spark: SparkSession, folder: str) -> DataFrame:
    """Performance rows with the order number ``k`` that their defects are planted by."""
    day, k, ln = F.col("day"), F.col("l_orderkey"), F.col("l_linenumber")
    sk, px = F.col("l_suppkey"), F.col("l_extendedprice")
    qn = F.col("l_quantity").cast("bigint")

    def every(n: int) -> Column:
        return k % n == 0

    lines = (
        _table(spark, folder, "lineitem")
        .withColumn("day", F.col("l_shipdate").cast("date"))
        .filter(~day.isin(OUTAGE))
        .filter(~((day == F.lit(PARTIAL_DAY)) & (k % 3 != 0)))
        .join(_suppliers(spark, folder), F.col("s_suppkey") == sk, "left")
    )
    day_first = every(97) & (F.dayofmonth(day) <= 12)
    multiple = F.when(sk % 10 == 0, 0).when(sk % 10 == 1, 1).otherwise(ln)
    rows = lines.select(
        F.when(day_first, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, ISO_TEXT))
        .alias("date"),
        F.when(every(251), "S999999").otherwise(F.concat(F.lit("S"), _text(sk))).alias("campaign_id"),
        F.concat(F.lit("K"), _text(F.col("l_partkey"))).alias("creative_id"),
        _text(qn * 1000 + ln).alias("impressions"),
        _text(F.when(every(503), qn * 1000 + ln + 7).otherwise(qn * 10)).alias("clicks"),
        _text(F.when(ln % 3 == 0, 0).otherwise(ln)).alias("conversions"),
        _text(F.when(every(401), -px).otherwise(px)).alias("spend"),
        F.when(~every(89), _text(px * multiple)).alias("revenue"),
        F.when(every(211), "USD").otherwise(_currency()).alias("currency"),
        # Rows of every 307th order arrive twice.
        F.explode(F.array_repeat(F.lit(1), F.when(every(307), 2).otherwise(1))).alias("copy"),
        k.alias("k"),
    )
    return rows.drop("copy")


def raw_performance(spark: SparkSession, folder: str) -> DataFrame:
    return _performance(spark, folder).drop("k")


def raw_campaigns(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    known = _suppliers(spark, folder).filter(F.col("r_regionkey").isNotNull())
    return known.select(
        F.concat(F.lit("S"), _text(key)).alias("campaign_id"),
        F.col("s_name").alias("campaign_name"),
        F.when(key % 13 == 0, F.concat("n_name", F.lit(" ")))
        .when(key % 17 == 0, F.lower("n_name"))
        .otherwise(F.col("n_name"))
        .alias("channel"),
        F.when(key % 10 == 0, "awareness")
        .when(key % 10 == 1, "traffic")
        .otherwise("conversions")
        .alias("objective"),
        _currency().alias("currency"),
        _text(F.col("s_acctbal")).alias("daily_budget"),
        F.lit("1995-01-01").alias("start_date"),
        F.when(key % 7 == 0, "2001-06-30").alias("end_date"),
    )


def raw_creatives(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    campaigns = _table(spark, folder, "supplier").agg(F.count("*") + 2).scalar()
    return (
        _table(spark, folder, "part")
        .filter(key % 50 != 49)
        .select(
            F.concat(F.lit("K"), _text(key)).alias("creative_id"),
            F.concat(F.lit("S"), _text(key % campaigns)).alias("campaign_id"),
            F.col("p_name").alias("creative_name"),
            F.lower("p_type").alias("format"),
            F.col("p_brand").alias("headline"),
            F.lit("1995-01-01").alias("launched_on"),
        )
    )


def raw_fx(spark: SparkSession, folder: str) -> DataFrame:
    """Weekday quotes per region over the shipping days, one day delivered twice."""
    shipped = _table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    first, last = shipped.agg(F.min("d")).scalar(), shipped.agg(F.max("d")).scalar()
    usd = F.col("r_regionkey") == 1
    text_day = F.date_format("d", ISO_TEXT)
    copies = F.when(~usd & (text_day == TWICE_DELIVERED), 2).otherwise(1)
    quote = F.concat(
        F.lit("0.0"), _text(11000 + F.col("r_regionkey") * 1000 + F.dayofyear("d") % 13)
    )
    return (
        _table(spark, folder, "region")
        .withColumn("d", F.explode(F.sequence(first, last)))
        .filter(F.weekday("d") < 5)
        .select(
            text_day.alias("date"),
            _currency().alias("currency"),
            F.when(usd, "1.0").otherwise(quote).alias("rate_to_usd"),
            F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
        )
        .drop("copy")
    )


def sample_feeds(spark: SparkSession, folder: str) -> Feeds:
    return {
        "ad_performance_daily": raw_performance(spark, folder),
        "campaigns": raw_campaigns(spark, folder),
        "creatives": raw_creatives(spark, folder),
        "fx_rates": raw_fx(spark, folder),
    }


# The flawed feeds ------------------------------------------------------------

STRAY_DAY = "2031-01-01"
FIRST_QUOTE = "1995-04-01"
QUOTED_TWICE, OFF_BASE = "2001-08-06", "2001-08-07"


def _planted(c: str, *cases: tuple[int, str | Column]) -> Column:
    """The column, replaced in the rows of every n-th order."""
    out = F.col(c)
    for n, value in reversed(cases):
        out = F.when(F.col("k") % n == 0, value).otherwise(out)
    return out.alias(c)


def flawed_feeds(spark: SparkSession, folder: str) -> Feeds:
    """The sample feeds with the graver defects: unreadable numbers and dates, a stray year, days before
    the first quote, a day quoted twice, a base rate off one, impossible values, reversed and late windows,
    and drifted columns."""
    perf = _performance(spark, folder)
    planted = {
        "date": [(367, F.lit("soon")), (499, F.lit(STRAY_DAY))],
        "impressions": [(439, F.lit("12.5")), (241, F.lit("many"))],
        "conversions": [(431, F.lit("-1"))],
        "spend": [(313, F.lit("n/a")), (317, F.lit("nan"))],
        "revenue": [(421, F.concat(F.lit("-"), F.col("revenue"))), (331, F.lit("inf"))],
    }
    base = sample_feeds(spark, folder)
    number = F.substring("campaign_id", 2, 20).cast("bigint")
    campaigns = base["campaigns"].withColumns(
        {
            "start_date": F.when(number % 23 == 3, "1999-01-01").otherwise(F.col("start_date")),
            "end_date": F.when(number % 19 == 2, "1994-01-01").otherwise(F.col("end_date")),
        }
    )
    quoted = base["fx_rates"].filter(F.col("date") >= FIRST_QUOTE)
    off_base = (F.col("date") == OFF_BASE) & (F.col("currency") == "USD")
    fx = quoted.withColumn("rate_to_usd", F.when(off_base, "1.01").otherwise(F.col("rate_to_usd")))
    again = quoted.filter((F.col("date") == QUOTED_TWICE) & (F.col("currency") != "USD")).distinct()
    return {
        "ad_performance_daily": perf.select(*[_planted(c, *planted.get(c, [])) for c in perf.columns if c != "k"]),
        "campaigns": campaigns,
        "creatives": base["creatives"].withColumn("owner", F.col("creative_id")).drop("headline"),
        "fx_rates": fx.unionByName(again.withColumn("rate_to_usd", F.lit("0.09"))),
    }


# Feeds as delivered -----------------------------------------------------------


def write_as_csv(feeds: Feeds, folder: str) -> None:
    """Feeds as folders of CSV files. Creatives arrive in two column orders, and some quotes with a field
    too many or too few."""
    for name, df in feeds.items():
        path = f"{folder}/{name}.csv"
        writer = {"header": True, "escape": '"'}
        if name == "creatives":
            key = F.substring("creative_id", 2, 20).cast("bigint")
            df.filter(key % 2 == 0).write.options(**writer).csv(path)
            df.filter(key % 2 == 1).select(*reversed(df.columns)).write.options(**writer).mode("append").csv(path)
            continue
        df.write.options(**writer).csv(path)
        if name == "fx_rates":
            day = F.substring("date", 9, 2)
            fields = [F.col("date"), F.col("currency")]
            lines = df.filter(day.isin("13", "14")).select(
                F.lit(1).alias("place"),
                F.when(day == "13", F.concat_ws(",", *fields, "rate_to_usd", F.lit("surplus")))
                .otherwise(F.concat_ws(",", *fields))
                .alias("value"),
            )
            header = df.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(",".join(df.columns)).alias("value"))
            # A file of its own, with the header on top.
            one = header.unionByName(lines).coalesce(1).sortWithinPartitions("place").select("value")
            one.write.mode("append").option("compression", "none").text(f"{folder}/malformed")
            df.sparkSession.read.text(f"{folder}/malformed").coalesce(1).write.mode("append").text(path)
