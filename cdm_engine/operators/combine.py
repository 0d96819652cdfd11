"""Appending tables, and counting their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Store


def append_distinct(store: Store, tables: dict[str, list[str]], target: str | None = None, date_columns: list[str] | None = None) -> DataFrame:
    """Rows of all tables, each once. Columns are matched by position and named as in the first table; a
    table that doesn't exist is an error. ``date_columns`` come back as dates, also from day numbers since 1970."""
    lacking = [t for t in tables if not store.exists(t)]
    if lacking or not tables:
        raise ValueError(f"no such tables: {lacking}" if lacking else "there is at least one table to append")
    parts = [store.get(t).select(*[F.col(f"`{c}`") for c in cols]) for t, cols in tables.items()]
    out = reduce(DataFrame.union, parts).distinct()
    for c in date_columns or []:
        whole = isinstance(out.schema[c].dataType, T.IntegralType)
        out = out.withColumn(c, F.date_from_unix_date(F.col(c).cast("int")) if whole else F.col(c).cast("date"))
    return store.put(target, out) if target else out


def row_counts(store: Store, names: list[str] | None = None) -> DataFrame:
    """name, row_count of the tables and views: one job, which reads no columns."""
    names = store.names() if names is None else names
    if not names:
        raise ValueError("there are no tables to count")
    each = [store.get(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count") for n in names]
    return reduce(DataFrame.unionAll, each)
