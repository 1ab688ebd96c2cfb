import pytest
from pyspark.sql import functions as F

from spendlens.plans.joins import counted_bytes, fits_broadcast, lookup_join, spread_left_join


@pytest.fixture(scope="module")
def sides(spark):
    # A third of the rows on one key, some without a key, some unmatched.
    fact = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 400))
        .alias("k"),
        F.col("id").alias("v"),
    )
    names = [("hot", "H")] + [(f"k{i}", f"N{i}") for i in range(0, 300)] + [("k7", "twice"), (None, "never")]
    return fact, spark.createDataFrame(names, "k string, name string")


def test_spread_join_equals_the_plain_join(sides):
    fact, lookup = sides
    plain = fact.join(lookup, "k", "left").select("k", "v", "name")
    spread = spread_left_join(fact, lookup, ["k"]).select("k", "v", "name")
    assert spread.count() == plain.count()
    assert spread.exceptAll(plain).count() == 0


def test_hot_key_is_spread_over_tasks(spark, sides):
    fact, lookup = sides
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spread_left_join(fact, lookup, ["k"]).withColumn("task", F.spark_partition_id())
        hot = rows.filter("k = 'hot'").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(hot) > 1 and max(r["count"] for r in hot) < 2000


def test_broadcast_only_below_the_limit(sides):
    fact, lookup = sides
    size = counted_bytes(lookup)
    assert size > 300 * 40
    assert fits_broadcast(lookup, size) and not fits_broadcast(lookup, size - 1)
    both = [lookup_join(fact, lookup, ["k"], limit).select("k", "v", "name") for limit in (size, 0)]
    assert both[0].exceptAll(both[1]).count() == 0 and both[0].count() == both[1].count()


def test_two_key_spread_join(spark):
    fact = spark.range(1000).select((F.col("id") % 2).alias("a"), F.lit("x").alias("b"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([(0, "x", 1.0), (1, "y", 2.0)], "a long, b string, r double")
    got = spread_left_join(fact, lookup, ["a", "b"])
    assert got.filter("r = 1.0").count() == 500 and got.count() == 1000
