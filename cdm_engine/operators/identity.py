"""Stable record identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import ROW_SEQ


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped text that depends on the parts alone (SHA-256, 128 bits shown)."""
    # every part with its length before it, so that no two lists of parts read alike; NULL is '-'
    texts = [p.cast("string") for p in parts]
    h = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def assign_ids(df: DataFrame, table: str, key: list[str] | None = None) -> DataFrame:
    """Puts ``ori_table`` and ``unique_id`` before the other columns, in place of earlier ones. The id is that of
    table and ``key``: by default the file (its name within the instance) and the row's number in it, which depend neither on
    where the instance lies nor on how files are split; without these all columns (rows alike then share an id)."""
    data = [c for c in df.columns if c not in ("ori_table", "unique_id")]
    key = key or ([ROW_SEQ] if ROW_SEQ in data else data)
    parts = [F.col(f"`{c}`.`{f}`") if c == ROW_SEQ and f else F.col(f"`{c}`") for c in key for f in (df.schema[c].dataType.names if c == ROW_SEQ and isinstance(df.schema[c].dataType, T.StructType) else [None])]
    return df.select(F.lit(table).alias("ori_table"), stable_id(F.lit(table), *parts).alias("unique_id"), *[F.col(f"`{c}`") for c in data])
