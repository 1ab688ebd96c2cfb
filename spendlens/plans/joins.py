"""Left joins of a fact to a lookup table, chosen by the measured lookup size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup is sent to every executor only when its counted bytes stay below this. The
# session setting may state another limit.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_SETTING = "spark.spendlens.broadcastBytes"


def broadcast_limit(spark) -> int:
    return int(spark.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))


def counted_bytes(df: DataFrame) -> int:
    """Rows times a fixed overhead plus the text they hold, by one aggregate."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    per_row = F.lit(8 * len(df.columns) + 32)
    for part in text:
        per_row = per_row + part
    return df.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    return counted_bytes(df) <= (broadcast_limit(df.sparkSession) if limit is None else limit)


def spread_left_join(fact: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Shuffled left join in which a hot key is spread over many tasks.

    Each key gets as many salts as partitions it would fill on its own, so a key
    with a third of the rows takes a third of the tasks. The keys that need more
    than one salt are at most as many as there are partitions, which bounds both
    the broadcast list and the copies made of the lookup.
    """
    spark = fact.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = fact.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = (
        counts.withColumn("_salts", F.ceil(F.col("_n") * parts / total).cast("int"))
        .filter(F.col("_salts") > 1)
        .select(*on, "_salts")
    )
    # A NULL key matches nothing, so its rows need no partner and may go anywhere.
    keyless = F.lit(False)
    for key in on:
        keyless = keyless | F.col(key).isNull()
    spread = F.when(keyless, F.lit(parts)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    salted_fact = fact.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*fact.columns), spread).cast("int")
    )
    salted_lookup = lookup.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    joined = salted_fact.drop("_salts").join(salted_lookup.drop("_salts"), [*on, "_salt"], "left")
    return joined.drop("_salt")


def lookup_join(
    fact: DataFrame, lookup: DataFrame, on: list[str], limit: int | None = None
) -> DataFrame:
    """Left join that keeps every fact row; broadcast only below the byte limit."""
    if fits_broadcast(lookup, limit):
        return fact.join(F.broadcast(lookup), on, "left")
    return spread_left_join(fact, lookup, on)
