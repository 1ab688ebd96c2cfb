"""Checks that a result agrees with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.metrics import grouping_column, metric, roas
from spendlens.functions.numbers import rounded
from spendlens.operators.anomaly import SUSPECT_SHARE, anomaly
from spendlens.operators.periods import Period, in_period

BREAKDOWNS = ["channel", "campaign", "creative", "objective", "date"]
# Six decimals of money are more than any feed holds.
EXACT = "decimal(28,6)"
ROAS_LOW, ROAS_HIGH = 0.0, 50.0


def parts_sum_to_total(fact: DataFrame, name: str = "spend", tolerance: float = 0.01) -> DataFrame:
    """Each breakdown of an additive metric, summed again, against the plain total.

    One scan sums three levels: all rows, days, and the finest combination of the other
    groupings, which has no days and so leaves a fraction of the rows. The breakdowns
    but that by day are rolled up from the last. Summed as decimals, which add up to the
    same in any order, so sound data agree however large the total is.
    """
    m = metric(name)
    if m.is_ratio:
        raise ValueError(f"{name} is a ratio and its parts do not add up")
    columns = {group: grouping_column(group) for group in BREAKDOWNS}
    finest = [c for group, c in columns.items() if group != "date"]
    levels = fact.groupingSets([finest, [columns["date"]], []], *finest, columns["date"]).agg(
        F.sum(F.col(m.numerator).try_cast(EXACT)).alias("part"), F.grouping_id().alias("level")
    )

    def key(group: str) -> Column:
        return F.struct(F.lit(group).alias("grouping"), F.col(columns[group]).cast("string").alias("of"))

    # A bit is set for every column that a level has summed over; the date is the last.
    all_rows = F.struct(F.lit(None).cast("string").alias("grouping"), F.lit(None).cast("string").alias("of"))
    keys = (
        F.when(F.col("level") == 1, F.array(*[key(group) for group in BREAKDOWNS if group != "date"]))
        .when(F.col("level") == 2 ** (len(finest) + 1) - 1, F.array(all_rows))
        .otherwise(F.array(key("date")))
    )
    rolled = levels.select("part", F.explode(keys).alias("k")).groupBy("k").agg(F.sum("part").alias("part"))
    sums = rolled.agg(
        F.sum(F.when(F.col("k.grouping").isNull(), F.col("part"))).alias("total"),
        *[F.sum(F.when(F.col("k.grouping") == group, F.col("part"))).alias(f"of_{group}") for group in BREAKDOWNS],
    )
    rows = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(f"of_{g}").alias("parts")) for g in BREAKDOWNS])
    return sums.select("total", F.inline(rows)).select(
        "grouping",
        rounded(F.col("parts").cast("double"), m.digits).alias("parts_total"),
        rounded(F.col("total").cast("double"), m.digits).alias("total"),
        (F.abs(F.col("parts") - F.col("total")) <= tolerance).alias("agrees"),
    )


def ratio_bounds(
    fact: DataFrame, group_by: str = "campaign", period: Period | None = None,
    low: float = ROAS_LOW, high: float = ROAS_HIGH,
) -> DataFrame:
    """ROAS per group and whether it lies in the plausible range."""
    column = grouping_column(group_by)
    return (
        in_period(fact, period)
        .groupBy(column)
        .agg(rounded(roas(), 2).alias("roas"))
        .withColumn("plausible", F.coalesce(F.col("roas").between(low, high), F.lit(True)))
    )


def row_density(fact: DataFrame, period: Period | None = None, share: float = SUSPECT_SHARE) -> DataFrame:
    """Days with far fewer rows than the reported days before them."""
    days = anomaly(fact, "impressions", period)
    return days.filter(F.col("rows_reported") < share * F.col("median_rows_reported")).select(
        "date", "rows_reported", "median_rows_reported"
    )


BUCKETS = 1024


def _bucket(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.lit(BUCKETS))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets of row hashes in which two results differ as bags of rows.

    A bucket is named by its number of rows and by the sums and exclusive ors of two hashes of
    its rows, which do not depend on the order of rows and are added up in the tasks: what
    is shuffled are at most ``BUCKETS`` rows per task.
    """

    def marks(df: DataFrame) -> DataFrame:
        a, b = F.xxhash64(*df.columns), F.xxhash64(F.lit("again"), *df.columns)
        # Halves, so that no sum runs over.
        parts = [F.sum(F.shiftrightunsigned(h, 32)) for h in (a, b)] + [F.sum(h.bitwiseAND(F.lit(2**32 - 1))) for h in (a, b)]
        marks = F.struct(F.count("*"), F.bit_xor(a), F.bit_xor(b), *parts)
        return df.groupBy(_bucket(df).alias("bucket")).agg(marks.alias("marks"))

    one, two = marks(left), marks(right.select(*left.columns)).withColumnRenamed("marks", "others")
    return one.join(two, "bucket", "full").filter(~F.col("marks").eqNullSafe(F.col("others"))).select("bucket")


def result_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one of two results holds, duplicates counted.

    Fingerprints decide which buckets differ, and only rows of these are compared: of equal
    results no row is shuffled. Columns must be of kinds that can be hashed.
    """
    right = right.select(*left.columns)
    differs = F.broadcast(differing_buckets(left, right))

    def of_interest(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_bucket", _bucket(df))
        return rows.join(differs, rows["_bucket"] == differs["bucket"], "left_semi").drop("_bucket")

    one, two = of_interest(left), of_interest(right)
    lost = one.exceptAll(two).withColumn("side", F.lit("left_only"))
    added = two.exceptAll(one).withColumn("side", F.lit("right_only"))
    return lost.unionByName(added)


def changed_cells(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Cells in which two results with the same keys differ: the keys, the column and both values as text.

    Numbers that differ by ``tolerance`` at most are the same. A row that only one result
    has differs in every column, its other side being NULL. Keys name a row in either.
    """
    values = [c for c in left.columns if c not in keys]
    diff = result_diff(left, right)
    sides = []
    for side, prefix in (("left_only", "l"), ("right_only", "r")):
        own = diff.filter(F.col("side") == side)
        sides.append(own.select(*[F.col(k).alias(f"{prefix}_{k}") for k in keys], F.struct(*values).alias(prefix)))
    meets = F.lit(True)
    for k in keys:
        meets = meets & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    both = sides[0].join(sides[1], meets, "full")
    numeric = {f.name for f in left.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}

    def differs(c: str) -> Column:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        off = ~x.eqNullSafe(y)
        if c in numeric and tolerance:
            off = off & F.coalesce(F.abs(x.cast("double") - y.cast("double")) > tolerance, F.lit(True))
        return F.col("l").isNull() | F.col("r").isNull() | off

    cells = F.filter(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"l.{c}").cast("string").alias("left_value"),
                     F.col(f"r.{c}").cast("string").alias("right_value"), differs(c).alias("off"))
            for c in values
        ]),
        lambda cell: cell["off"],
    )
    named = [F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys]
    return both.select(*named, F.explode(cells).alias("cell")).select(*keys, "cell.column", "cell.left_value", "cell.right_value")
