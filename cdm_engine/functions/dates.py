"""Dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in which dates are written.
EIGHT_DIGITS = r"^[0-9]{8}$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_LOOSE = r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,2}"


def iso_date(c: Column) -> Column:
    """year-month-day (also with slashes, short parts, padding or a time behind it); else NULL."""
    return F.when(c.rlike(_LOOSE), F.translate(c, "/", "-").try_cast("date"))


def digits_date(c: Column) -> Column:
    """yyyymmdd; anything else, and days that don't exist, are NULL."""
    return F.when(c.rlike(EIGHT_DIGITS), F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2)).try_cast("date"))


def repaired(c: Column, source: str) -> Column:
    """A date column that isn't all ISO: yyyymmdd counts, from parquet also yyyy-mm-dd."""
    if source == "csv":
        return digits_date(c)
    return F.coalesce(digits_date(c), F.when(c.rlike(ISO), c.try_cast("date")))


def any_date(c: Column) -> Column:
    """Row by row: either form."""
    return F.coalesce(digits_date(c), iso_date(c))
