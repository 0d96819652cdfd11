"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import delete, fresh_path


#: Spark's own switch that removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied_shuffles(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle inside is removed from the disks as they end, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


#: For tables with rows of up to a megabyte: a reader holds a row group at a time, and a writer otherwise looks at its size after 100 rows.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 16}


def materialize(df: DataFrame, label: str, tidy: bool = False, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs neither recompute
    it nor depend on one executor's disk. ``tidy``: with ``tidied_shuffles``; ``wide``: with ``SMALL_GROUPS``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with tidied_shuffles(spark) if tidy else nullcontext():
        df.write.options(**(SMALL_GROUPS if wide else {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def materialize_each(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """One table of the rows of all ``parts`` (at least one, of one schema), each written before the next is asked for."""
    path = ""
    for part in parts:
        path = path or fresh_path(part.sparkSession, label)
        part.write.mode("append").parquet(path)
    table = part.sparkSession.read.schema(part.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no result depends on any more."""
    for table in tables:
        delete(table.sparkSession, table._stored_at)
