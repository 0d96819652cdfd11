"""Missing values in text, and folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing besides NULL (exact and untrimmed).
MISSING = ("", "NA")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def csv_text(c: Column) -> Column:
    """A CSV field as it was written: empty stays empty, the token NA is NULL."""
    return F.nullif(F.coalesce(c, F.lit("")), F.lit("NA"))


def present(c: Column, kind: T.DataType) -> Column:
    """Neither NULL nor, in text, one of MISSING."""
    return c.isNotNull() & ~c.isin(*MISSING) if isinstance(kind, T.StringType) else c.isNotNull()


def folded(c: Column) -> Column:
    """The form in which values are compared: text in upper case."""
    return F.upper(c.cast("string"))


def trimmed(c: Column) -> Column:
    """Without blanks, tabs and line ends at either side; NULL if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
