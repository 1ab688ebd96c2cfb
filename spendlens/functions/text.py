"""Cleaning expressions for feeds that arrive entirely as text.

Every cast is a ``try_`` form: a bad value becomes NULL and is counted, it never
fails a job that has been running for an hour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single-letter month and day accept padded and unpadded digits alike.
ISO = "yyyy-M-d"
DAY_FIRST = "d/M/yyyy"
MONTH_FIRST = "M/d/yyyy"

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}$"

# Characters that count as stray whitespace around a category value.
BLANKS = " \t\r\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_category(c: Column | str) -> Column:
    """Trimmed lower-case text with spaces turned into underscores."""
    return F.replace(F.lower(F.trim(_col(c))), F.lit(" "), F.lit("_"))


def norm_label(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c)))


def norm_code(c: Column | str) -> Column:
    """Trimmed upper-case code, as used for currencies."""
    return F.upper(F.trim(_col(c)))


def safe_double(c: Column | str) -> Column:
    """Text to DOUBLE, NULL when it is not a number.

    Java accepts a type suffix ("12d"), which no data feed means as a number. Text
    for "not a number" or an infinity is none either: one such cell would turn every
    sum over it into the same, so it counts as unreadable.
    """
    raw = _col(c)
    tail = F.right(F.trim(raw), F.lit(1))
    number = F.when(~tail.isin("d", "D", "f", "F"), raw).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def safe_long(c: Column | str) -> Column:
    """Text to BIGINT, NULL when it is not a number.

    Plain integers take the cheap cast. Only text which fails it ("12.0", "1e3")
    goes through a decimal and is rounded half up.
    """
    raw = _col(c)
    widened = F.round(F.trim(raw).try_cast("decimal(38,10)"), 0)
    return F.coalesce(raw.try_cast("bigint"), widened.try_cast("bigint"))


def parse_dates(c: Column | str, formats: tuple[str, ...] = (ISO, DAY_FIRST)) -> Column:
    """The first of the known formats that fits, in fixed order; NULL otherwise.

    A date in full ISO shape takes the plain cast, which is far cheaper than a
    pattern; only other text is tried against the formats.
    """
    text = F.trim(_col(c))
    tries = [F.try_to_date(text, fmt) for fmt in formats]
    if formats[0] == ISO:
        tries.insert(0, F.when(text.rlike(ISO_SHAPE), text.try_cast("date")))
    return F.coalesce(*tries)


def non_iso_flag(c: Column | str) -> Column:
    return ~F.trim(_col(c)).rlike(ISO_SHAPE)


def is_ambiguous_date(c: Column | str) -> Column:
    """Both slash readings parse, and to different days."""
    text = F.trim(_col(c))
    differ = F.try_to_date(text, MONTH_FIRST) != F.try_to_date(text, DAY_FIRST)
    return text.contains("/") & F.coalesce(differ, F.lit(False))


def has_stray_blanks(c: Column | str) -> Column:
    raw = _col(c)
    return F.btrim(raw, F.lit(BLANKS)) != raw


def is_blank(c: Column | str) -> Column:
    """NULL, or nothing but whitespace."""
    return F.btrim(F.coalesce(_col(c), F.lit("")), F.lit(BLANKS)) == ""
