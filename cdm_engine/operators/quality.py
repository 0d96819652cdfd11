"""Incomplete and duplicate rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import present
from ..sources.files import is_folder
from ..store import ROW_SEQ, observed


def _known(df: DataFrame, columns: list[str]) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"no such columns: {lacking}")


#: What is counted: rows before, and those that go.
BEFORE, INCOMPLETE, COPIES = "rows before", "incomplete rows removed", "copies removed"


def drop_missing(df: DataFrame, columns: list[str], counted: Observation | None = None) -> DataFrame:
    """Rows in which all the columns are present; '' and 'NA' count as missing in text. ``counted``: an observation in which
    the first job that reads the result finds BEFORE and INCOMPLETE; no job is added."""
    _known(df, columns)
    kinds = {f.name: f.dataType for f in df.schema}
    whole = reduce(and_, [present(F.col(f"`{c}`"), kinds[c]) for c in columns]) if columns else F.lit(True)
    if counted is not None:
        df = df.observe(counted, F.count(F.lit(1)).alias(BEFORE), F.count_if(~whole).alias(INCOMPLETE))
    return df.where(whole) if columns else df


def dedup(df: DataFrame, keys: list[str] | str = "*", mode: str = "full_row", order: str = ROW_SEQ) -> tuple[DataFrame, DataFrame | None]:
    """(kept, removed).

    ``full_row``: one of each set of rows alike in all columns; removed is None, as copies can't be told apart.
    ``keep_first``: of rows alike in ``keys`` (NULLs are alike) the one that ``order`` puts first; of several with that order
    the one with the smallest 128-bit hash of all its columns (rows alike in all columns can't be told apart and stay
    together). The first of each key is a partial aggregate and the split a semi-join on key, order and
    hash, so that a key with very many rows doesn't gather in one task.
    """
    data = [c for c in df.columns if c != ROW_SEQ]
    keys = data if keys == "*" else list(keys)
    _known(df, keys)
    if mode == "full_row":
        return df.dropDuplicates(data), None
    if mode != "keep_first":
        raise ValueError("mode is full_row or keep_first")
    first, same = _first(df, keys, order)
    return df.join(first, same, "left_semi"), df.join(first, same, "left_anti")


def _first(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, Column]:
    """The first place of each key, and the condition under which a row is at it."""
    _known(df, [order])
    data = [c for c in df.columns if c != ROW_SEQ]
    row = [F.col(f"`{c}`") for c in data]
    place = F.struct(F.col(f"`{order}`"), F.xxhash64(*row), F.xxhash64(F.lit(7), *row))
    first = df.groupBy(*[F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)]).agg(F.min(place).alias("_first"))
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)], place.eqNullSafe(F.col("_first")))
    return first, same


def dedup_split(df: DataFrame, keys: list[str] | str, folder: str, order: str = ROW_SEQ) -> tuple[DataFrame | None, DataFrame | None, dict[str, int]]:
    """(kept, removed, counts) as ``dedup`` has them in the mode keep_first, by one job that writes both sides to ``folder``, each to a
    folder below it; a side without rows is None. Readers of either side compute nothing again."""
    keys = [c for c in df.columns if c != ROW_SEQ] if keys == "*" else list(keys)
    _known(df, keys)
    first, same = _first(df, keys, order)
    counted = Observation("copies")
    sides = df.join(first, same, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col("_first").isNotNull().alias(_SIDE))
    sides.observe(counted, F.count(F.lit(1)).alias(BEFORE), F.count_if(~F.col(_SIDE)).alias(COPIES)).write.partitionBy(_SIDE).parquet(folder)
    spark = df.sparkSession
    paths = [f"{folder}/{side_folder(kept)}" for kept in (True, False)]
    kept, removed = (spark.read.schema(df.schema).parquet(p) if is_folder(spark, p) else None for p in paths)
    return kept, removed, observed(counted)


_SIDE = "_kept_by_dedup"


def side_folder(kept: bool) -> str:
    return f"{_SIDE}={str(kept).lower()}"


def dedup_as_configured(df: DataFrame, keys: list[str] | str, to_view: bool, save_deleted: bool, save_path: str | None) -> tuple[DataFrame, DataFrame | None]:
    """The modes that a configuration means: views and runs that keep no deleted rows compare whole
    rows; keys count only where deleted rows are saved; without a place to save to nothing happens."""
    if to_view or not save_deleted:
        return dedup(df, "*", "full_row")
    return dedup(df, keys, "keep_first") if save_path else (df, None)
