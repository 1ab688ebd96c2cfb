"""Rounding and medians of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """Rounds the stored binary value, halves away from zero.

    Spark's own ``round`` goes by the shortest decimal text of a double, so it takes
    1.005 up although the stored value lies below. Scaling first rounds what is
    really there, as the engines do whose results ours are compared with.
    """
    value = F.col(value) if isinstance(value, str) else value
    if digits == 0:
        return F.round(value, 0)
    scale = F.lit(float(10**digits))
    return F.round(value * scale, 0) / scale


def median_of(values: Column) -> Column:
    """Median of a small array without NULLs; NULL when it is empty."""
    ordered = F.array_sort(values)
    size = F.size(ordered)
    middle = F.floor((size + 1) / 2).cast("int")
    low = F.when(size > 0, F.get(ordered, middle - 1)).cast("double")
    high = F.when(size > 0, F.get(ordered, size - middle)).cast("double")
    return low + (high - low) / 2
