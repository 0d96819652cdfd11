"""Physical layout instead of indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..store import Store


@dataclass(frozen=True)
class Layout:
    """Files sorted by ``columns`` (so that parquet statistics skip row groups). In a database also: ``lookups``, columns with bloom filters, by
    which a search for single values skips row groups that don't have them; and ``buckets``, a number of buckets of
    ``columns``: joins on these columns between tables of as many buckets shuffle nothing."""

    table: str
    columns: tuple[str, ...]
    buckets: int = 0
    lookups: tuple[str, ...] = ()


def apply_layout(store: Store, specs: list[Layout]) -> dict[str, DataFrame]:
    """New versions of the tables, laid out. A database writes them and lists them in one state; elsewhere they are sorted when
    they are saved. No specs: nothing to do; unknown tables and columns are errors."""
    out, made = {}, {}
    for s in specs:
        df = store.get(s.table)
        lacking = [c for c in (*s.columns, *s.lookups) if c not in df.columns]
        if lacking or not s.columns:
            raise ValueError(f"{s.table} has no columns {lacking}" if lacking else f"{s.table}: no columns to sort by")
        if store.root:
            made[s.table] = store.write(s.table, df, {"columns": list(s.columns), "buckets": s.buckets, "lookups": list(s.lookups)})
        elif s.buckets or s.lookups:
            raise ValueError(f"{s.table}: buckets and lookups are kept by a store that is opened on a folder")
        else:
            out[s.table] = store.put(s.table, df.sortWithinPartitions(*s.columns))
    if made:
        store.commit([], made)
        out = {t: store.get(t) for t in made}
    return out
