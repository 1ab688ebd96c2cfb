"""The plans behind the named queries stay fit for large tables."""

import os

import pytest

from pyspark.sql import functions as F

from __spark_entry__ import queries
from spendlens.catalog.queries import catalog, workspace
from spendlens.plans.quantiles import bucket_counts

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(catalog()))
def test_no_pairing_of_everything_and_no_python(spark, key):
    text = plan(queries()[key](spark, FOLDER))
    for word in ("NestedLoop", "Cartesian", "Python", "MapInPandas"):
        assert word not in text


@pytest.mark.parametrize(
    "key, columns",
    [
        ("agg_spend_by_channel", "channel,spend_usd,month"),
        ("agg_ctr", "impressions,clicks,spend_usd,conversions"),
        ("spend_by_channel_8_weeks", "date,channel,spend_usd,month"),
    ],
)
def test_only_needed_columns_are_read(spark, key, columns):
    scan = [l for l in plan(queries()[key](spark, FOLDER)).split("\n") if "FileScan" in l][0]
    read = {c.split("#")[0] for c in scan.split("[")[1].split("]")[0].split(",")}
    assert read - {"month"} == set(columns.split(",")) - {"month"}


def test_a_period_reads_its_months_only(spark):
    text = plan(queries()["spend_by_channel_8_weeks"](spark, FOLDER))
    assert "month" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date," in text


def test_the_last_day_check_reads_two_months_at_most(spark):
    text = plan(queries()["last_day_check"](spark, FOLDER))
    assert "(month#" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_sums_are_combined_before_the_shuffle(spark):
    for key in ("agg_spend_by_channel", "pause_scorecard", "dup_rows", "profile", "daily_volume"):
        text = plan(queries()[key](spark, FOLDER))
        assert "partial_" in text and "SortAggregate(key=[date" not in text


def test_audit_reads_the_written_counts_and_stays_small(spark):
    space = workspace(spark, FOLDER)
    text = plan(queries()["audit_findings"](spark, FOLDER))
    wide = [l for l in text.split("\n") if "Exchange hashpartitioning(" in l and "creative_id" in l and "revenue" in l]
    assert not wide and "raw/ad_performance_daily" not in text
    assert space.curated.performance.inputFiles()


def scans(df):
    return plan(df).count("FileScan")


def test_quartiles_do_not_shuffle_the_values(spark):
    space = workspace(spark, FOLDER)
    long = space.feeds["ad_performance_daily"].select(F.lit("a").alias("k"), F.col("spend").try_cast("double").alias("v"))
    counted = plan(bucket_counts(long, "k", "v"))
    # By key and bucket, with counts summed before.
    first = [l for l in counted.split("\n") if "Exchange hashpartitioning(" in l]
    assert len(first) == 1 and "v#" not in first[0] and "partial_count(1)" in counted
    # What is shuffled afterwards are counts of the values of a few narrow ranges.
    text = plan(queries()["numeric_summary"](spark, FOLDER))
    assert all("number" in l for l in text.split("\n") if "Exchange hashpartitioning(" in l and "value" in l)


def test_every_check_has_few_scans(spark):
    assert scans(queries()["audit_findings"](spark, FOLDER)) <= 12
    assert scans(queries()["parts_sum_to_total"](spark, FOLDER)) == 1
    # Two for each of four feeds: plain figures and distinct values.
    assert scans(queries()["profile"](spark, FOLDER)) <= 8
    assert scans(queries()["quality_report"](spark, FOLDER)) == scans(queries()["row_accounting"](spark, FOLDER)) == 0


def test_distinct_values_are_shuffled_as_numbers(spark):
    text = plan(queries()["profile"](spark, FOLDER))
    assert "Expand" not in text
    wide = [l for l in text.split("\n") if "Exchange hashpartitioning(" in l and "campaign_name" in l]
    assert not wide


def test_series_by_entity_are_summed_before_their_windows(spark):
    text = plan(queries()["anomaly_conversions_by_campaign"](spark, FOLDER))
    assert text.index("Window") < text.index("partial_") and "Exchange SinglePartition" not in text


def test_shared_tables_are_written_once(spark):
    space = workspace(spark, FOLDER)
    assert workspace(spark, FOLDER + "/") is space
    before = space.curated
    queries()["kpis"](spark, FOLDER).collect()
    assert space.curated is before
