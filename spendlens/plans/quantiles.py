"""Exact interpolated quantiles without gathering a column into one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per doubling of the absolute value.
STEPS = 256
# Lifts the smallest positive double's bucket above zero.
LIFT = 1100 * STEPS
# Parts into which a range that holds too many rows is cut, and how many rows may be sorted together.
PARTS = 4096
MOST_ROWS = 100_000


def _bucket(value: Column) -> Column:
    """A bucket number that never decreases when the value grows."""
    size = F.least(F.abs(value), F.lit(1.7e308))
    step = F.floor(F.log2(size) * STEPS) + LIFT
    signed = F.when(value > 0, step).when(value < 0, -step)
    return F.coalesce(signed, F.lit(0))


@dataclass(frozen=True)
class Range:
    """Values of a key from ``low`` to ``high``: how many rows lie before and in it, and the positions wanted out of it."""

    key: object
    low: float
    high: float
    before: int
    held: int
    wanted: tuple[tuple[str, float], ...]


def bucket_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, range, mean and summed squared deviations of every bucket of every key, one scan, summed in the tasks."""
    v = F.col(value)
    rows = df.filter(F.col(key).isNotNull() & v.isNotNull())
    return rows.groupBy(F.col(key).alias("key"), _bucket(v).alias("bucket")).agg(
        F.count("*").alias("held"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count("*")).alias("squares"),
    )


def _wanted_ranges(counts: DataFrame, names: list[str], before: Column, wanted: Column) -> list[Range]:
    """Ranges that hold a wanted position: two for each quantile and key at most, so they come to the driver."""
    own = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_before", before + F.sum("held").over(own) - F.col("held"))
    inside = F.filter(
        wanted,
        lambda w: (F.ceil(w["position"]) >= F.col("_before")) & (F.floor(w["position"]) < F.col("_before") + F.col("held")),
    )
    found = placed.withColumn("_inside", inside).filter(F.size("_inside") > 0)
    return [
        Range(r.key, r.low, r.high, r["_before"], r.held, tuple((w["name"], w["position"]) for w in r["_inside"]))
        for r in found.collect()
    ]


def _table(df: DataFrame, key: str, ranges: list[Range]) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, number int, low double, high double, before bigint, wanted array<struct<name:string,position:double>>"
    rows = [(r.key, i, r.low, r.high, r.before, list(r.wanted)) for i, r in enumerate(ranges)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _rows_in(df: DataFrame, key: str, value: str, ranges: list[Range]) -> DataFrame:
    """Rows that lie in any of the ranges, with its number. The list is bounded by keys and quantiles."""
    table = _table(df, key, ranges).withColumnRenamed("key", "_key")
    v = F.col(value)
    inside = (F.col(key) == F.col("_key")) & v.between(F.col("low"), F.col("high"))
    return df.join(table, inside).select(F.col("_key").alias("key"), v.alias("value"), "number", "low", "high", "before", "wanted")


def _refined(df: DataFrame, key: str, value: str, ranges: list[Range]) -> list[Range]:
    """The same positions in narrower ranges: each range is cut evenly, counted, and what holds a position is kept."""
    rows = _rows_in(df, key, value, ranges)
    # Halved, as the width of a range may be more than a double can hold.
    at = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    part = F.least(F.floor(at * PARTS), F.lit(PARTS - 1)).alias("bucket")
    counts = rows.groupBy("key", "number", "before", "wanted", part).agg(
        F.count("*").alias("held"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return _wanted_ranges(counts, ["key", "number"], F.col("before"), F.col("wanted"))


def exact_quantiles(
    df: DataFrame, key: str, value: str, probs: dict[str, float], counts: DataFrame | None = None, most_rows: int | None = None
) -> DataFrame:
    """One row per key with a column per named quantile, linearly interpolated.

    Buckets are counted straight from the rows; ``counts`` may hand over those of
    ``bucket_counts``, written. Ranges that hold a wanted rank and more than ``most_rows`` rows
    are cut again and again, each time by one scan that only counts, until they are small or hold a
    single value. So no task sorts more rows than that, however close to each other the
    values are. Only rows of the ranges that are left are read once more and ordered.
    """
    most_rows = MOST_ROWS if most_rows is None else most_rows
    counts = bucket_counts(df, key, value) if counts is None else counts
    total = F.sum("held").over(Window.partitionBy("key"))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * F.lit(float(p))).alias("position")) for name, p in probs.items()
    ])
    ranges = _wanted_ranges(counts.withColumn("total", total), ["key"], F.lit(0), wanted)

    def wide(r: Range) -> bool:
        return r.held > most_rows and r.low < r.high

    while any(map(wide, ranges)):
        finer = _refined(df, key, value, [r for r in ranges if wide(r)])
        ranges = [r for r in ranges if not wide(r)] + finer
    # Ranges of one value need no rows any more.
    single = [(r.key, name, math.floor(p), math.ceil(p), p, r.low, r.before, r.held) for r in ranges if r.low == r.high for name, p in r.wanted]
    open_ranges = [r for r in ranges if r.low < r.high]
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, name string, lower bigint, upper bigint, position double, value double, before bigint, n bigint"
    placed = df.sparkSession.createDataFrame(single, schema).withColumn("upto", F.col("before") + F.col("n"))
    if open_ranges:
        inside = Window.partitionBy("key", "number").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        counted = _rows_in(df, key, value, open_ranges).groupBy("key", "number", "before", "wanted", "value").agg(F.count("*").alias("n"))
        rows = counted.withColumn("upto", F.sum("n").over(inside) + F.col("before")).withColumn("w", F.explode("wanted"))
        placed = placed.unionByName(rows.select(
            "key", "w.name", F.floor("w.position").alias("lower"), F.ceil("w.position").alias("upper"), "w.position", "value", "before", "n", "upto",
        ))
    holds_lower = (F.col("upto") > F.col("lower")) & (F.col("upto") - F.col("n") <= F.col("lower"))
    holds_upper = (F.col("upto") > F.col("upper")) & (F.col("upto") - F.col("n") <= F.col("upper"))
    ends = placed.groupBy("key", "name").agg(
        F.max(F.when(holds_lower, F.col("value"))).alias("low"),
        F.max(F.when(holds_upper, F.col("value"))).alias("high"),
        F.max(F.col("position") - F.col("lower")).alias("share"),
    )
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    return ends.groupBy(F.col("key").alias(key)).agg(
        *[F.max(F.when(F.col("name") == name, between)).alias(name) for name in probs]
    )


def plain_figures(counts: DataFrame, key: str) -> DataFrame:
    """Count, mean, sample deviation and range of every key, from the counts of its buckets.

    Squared deviations of the buckets are added to those of their means, so nothing large is subtracted.
    """
    n, per_key = F.col("held"), Window.partitionBy("key")
    mean = F.sum(F.col("mean") * n).over(per_key) / F.sum(n).over(per_key)
    rows = counts.withColumn("_mean", mean)
    squares = F.sum(F.col("squares") + n * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    return rows.groupBy(F.col("key").alias(key)).agg(
        F.sum(n).alias("n"),
        F.first("_mean").alias("mean"),
        F.sqrt(F.try_divide(squares, F.nullif(F.sum(n) - 1, F.lit(0)))).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
