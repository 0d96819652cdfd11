"""Writing concept tables, removed rows and reports."""

from __future__ import annotations

import io
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..store import ROW_SEQ, Store, observed
from .files import delete, is_folder, put


def add_to_table(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """A new version of a table with the rows behind; columns are matched by name, and the table exists."""
    old = store.get(name)
    extra = [c for c in rows.columns if c not in old.columns]
    if extra:
        raise ValueError(f"{name} has no columns {extra}")
    return store.put(name, old.unionByName(rows, allowMissingColumns=True))


def append_parquet(rows: DataFrame, folder: str, partition: str | None = "concept_id") -> None:
    """Adds files to a folder, by default one below it per concept, each row with ``tag`` 1. Earlier files stay,
    also without partitions. Rows of a concept are written by few tasks: one shuffle on the partition column
    with room to split large ones."""
    out = rows.withColumn("tag", F.lit(1))
    if partition:
        out.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(folder)
    else:
        out.write.mode("append").parquet(folder)


def save_removed(removed: DataFrame, folder: str, table: str, postfix: str | None = None, on: date | None = None) -> str | None:
    """``<folder>/<table>_<yyyymmdd>[_postfix].csv`` (a folder of CSV parts), if there are rows at all: they are counted by the job that writes them."""
    day = (on or date.today()).strftime("%Y%m%d")
    path = f"{folder.rstrip('/')}/{table}_{day}{f'_{postfix}' if postfix else ''}.csv"
    counted = Observation("removed")
    removed.drop(ROW_SEQ).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    if observed(counted).get("n"):
        return path
    delete(removed.sparkSession, path)
    return None


def _csv(df: DataFrame) -> bytes:
    return df.toPandas().to_csv(index=False).encode()  # a report has a row per table


def _parquet(df: DataFrame) -> bytes:
    out = io.BytesIO()
    df.toPandas().to_parquet(out, index=False)
    return out.getvalue()


#: Report writers by file extension (a report to a file's content); more can be added. The extension fst, for which there is no
#: writer here, gets parquet content under the extension parquet.
WRITERS: dict[str, Callable[[DataFrame], bytes]] = {"csv": _csv, "parquet": _parquet}
SUBSTITUTES = {"fst": "parquet"}


def write_report(df: DataFrame, folder: str, name: str) -> str:
    """Writes a small report with the writer for the name's extension and returns its path."""
    if not name:
        raise ValueError("a report has a name")
    stem, dot, ext = name.rpartition(".")
    if not dot or not ext or not stem:
        raise ValueError(f"{name!r} has no extension")
    ext = SUBSTITUTES.get(ext.lower(), ext.lower())
    if ext not in WRITERS:
        raise ValueError(f"no report writer for {ext!r}; there are {sorted(WRITERS)}")
    if not is_folder(df.sparkSession, folder):
        raise FileNotFoundError(f"no folder {folder}")
    path = f"{folder.rstrip('/')}/{stem}.{ext}"
    put(df.sparkSession, path, WRITERS[ext](df))
    return path
