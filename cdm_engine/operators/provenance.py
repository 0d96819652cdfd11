"""From derived records back to source values and rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import as_frame
from ..store import ROW_SEQ, Store
from .conform import Diagnostics

EMPTY = "ori_table string, unique_id string, column_origin string, value string"


def as_text(df: DataFrame, column: str):
    """A value of any type as text; truth values in upper case."""
    c = F.col(f"`{column}`")
    return F.upper(c.cast("string")) if isinstance(df.schema[column].dataType, T.BooleanType) else c.cast("string")


#: Ids up to which a table that is laid out for lookups is searched for them one by one.
POINTS = 64


def _points(store: Store, table: str, wanted: DataFrame) -> Column | None:
    """A condition on ``unique_id`` for the few ids that are wanted, which parquet answers by statistics and bloom filters before it reads row groups;
    None if they aren't few, or the table isn't laid out for lookups. ``wanted`` has one column."""
    layout = store.layout(table)
    if not layout or "unique_id" not in layout["lookups"] or not isinstance(store.get(table).schema["unique_id"].dataType, T.StringType):
        return None
    ids = [r[0] for r in wanted.where(F.col(wanted.columns[0]).isNotNull()).distinct().limit(POINTS + 1).collect()]
    return None if len(ids) > POINTS else reduce(or_, [F.col("unique_id") == i for i in sorted(ids)], F.lit(False))


def origin_values(store: Store, cases: DataFrame, scheme: list[tuple[str, str]], notes: Diagnostics | None = None) -> DataFrame:
    """ori_table, unique_id, column_origin, value, each once: for each (table, column) of the scheme the
    values of the cases (ori_table, unique_id) that come from that table. Absent tables and columns are noted and skipped."""
    notes = notes if notes is not None else Diagnostics()
    cases = as_frame(store.spark, cases, "there are no cases")
    lacking = {"ori_table", "unique_id"} - set(cases.columns)
    if lacking:
        raise ValueError(f"cases lack {sorted(lacking)}")
    parts = []
    points: dict[str, Column | None] = {}
    for table, column in scheme:
        if not store.exists(table):
            notes.add("warning", table, "does not exist")
        elif column not in store.columns(table) or "unique_id" not in store.columns(table):
            notes.add("warning", table, f"has no column {column} beside unique_id")
        else:
            source = store.get(table)
            own = cases.where(F.col("ori_table") == table).select("ori_table", F.col("unique_id").cast("string").alias("unique_id"))
            if table not in points:
                points[table] = _points(store, table, own.select("unique_id"))
            parts.append(
                (source if points[table] is None else source.where(points[table]))
                .select(F.col("unique_id").cast("string").alias("unique_id"), as_text(source, column).alias("value"))
                .join(own, "unique_id")
                .select("ori_table", "unique_id", F.lit(column).alias("column_origin"), "value")
            )
    if not parts:
        return store.spark.createDataFrame([], EMPTY)
    return reduce(DataFrame.unionByName, parts).distinct()


def origin_rows(store: Store, ids: DataFrame, tables: list[str] | None = None, notes: Diagnostics | None = None) -> dict[str, DataFrame]:
    """Table name -> its rows whose unique_id is listed for it in ``ids`` (ori_table, unique_id); repeated
    ids don't repeat rows. A few ids of a table that is laid out for lookups are searched for without reading the rest; tables that are bucketed by unique_id, as
``ids`` is, are joined where they lie. A table that is absent or has no ids of its own is noted and empty."""
    notes = notes if notes is not None else Diagnostics()
    ids = as_frame(store.spark, ids, "there are no ids")
    if {"ori_table", "unique_id"} - set(ids.columns):
        notes.add("warning", "", "ids have no ori_table and unique_id")
        return {}
    if tables is None:
        tables = [r[0] for r in ids.where("ori_table is not null").select("ori_table").distinct().collect()]
    out = {}
    for t in sorted(tables):
        if not store.exists(t):
            notes.add("warning", t, "does not exist")
        elif {"ori_table", "unique_id"} - set(store.columns(t)):
            notes.add("warning", t, "has no ori_table and unique_id")
        else:
            own = ids.where(F.col("ori_table") == t).select(F.col("unique_id").cast("string").alias("_wanted"))
            source, few = store.get(t), _points(store, t, own)
            if few is not None:
                out[t] = source.where(few).drop(ROW_SEQ)
                continue
            out[t] = source.join(own, source["unique_id"].cast("string") == own["_wanted"], "left_semi").drop(ROW_SEQ)
            continue
        out[t] = store.spark.createDataFrame([], "ori_table string, unique_id string")
    return out
