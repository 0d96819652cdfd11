"""Accepting tables in the forms in which callers have them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def as_frame(spark: SparkSession, data: Any, message: str | None = None) -> DataFrame:
    """A DataFrame as it is; pandas, Arrow and lists of rows or dicts converted; anything else is an error."""
    if isinstance(data, DataFrame):
        return data
    if data is None:
        raise ValueError(message or "there is no table")
    if hasattr(data, "to_pandas") and hasattr(data, "schema"):  # Arrow
        data = data.to_pandas()
    if hasattr(data, "iloc") or (isinstance(data, list) and data):
        return spark.createDataFrame(data)
    raise ValueError(message or f"{type(data).__name__} is not a table")
