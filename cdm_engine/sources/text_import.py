"""Importing a delimited file as text, with renamed columns, trimmed values, dates and a row filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import digits_date
from ..functions.text import trimmed


def clean_text(df: DataFrame, columns: dict[str, str] | list[str] | None = None, dates: list[str] | None = None, keep: Column | str | None = None) -> DataFrame:
    """``columns``: those to keep, as a list or as old -> new name. All values become text without blanks at
    either side, empty ones NULL; ``dates`` (new names) are yyyymmdd; ``keep`` filters rows at the end."""
    names = columns if isinstance(columns, dict) else {c: c for c in columns or df.columns}
    lacking = [c for c in names if c not in df.columns]
    if lacking:
        raise ValueError(f"no such columns: {lacking}")
    out = df.select(*[trimmed(F.col(f"`{c}`").cast("string")).alias(n) for c, n in names.items()])
    out = out.withColumns({c: digits_date(F.col(c)) for c in dates or []})
    return out.where(keep) if keep is not None else out


def import_text(spark: SparkSession, path: str, columns: dict[str, str] | list[str] | None = None, dates: list[str] | None = None, keep: Column | str | None = None, sep: str = ",") -> DataFrame:
    return clean_text(spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path), columns, dates, keep)
