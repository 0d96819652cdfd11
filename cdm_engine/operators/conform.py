"""Conforming loaded tables to their specification: columns, dates, blanks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import any_date, iso_date, repaired
from ..functions.text import blank_to_null, present
from ..spec import TableSpec
from ..store import ROW_SEQ


@dataclass
class Diagnostics:
    """What happened on the way: (level, table, text); and what was counted while a table was written (table, then what)."""

    entries: list[tuple[str, str, str]] = field(default_factory=list)
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def add(self, level: str, table: str, text: str) -> None:
        self.entries.append((level, table, text))

    def of(self, level: str) -> list[str]:
        return [f"{t}: {x}" for k, t, x in self.entries if k == level]


def add_mandatory(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Mandatory columns that are absent, as NULL, behind the others."""
    kinds = {"date": "date"}
    return df.withColumns({c.name: F.lit(None).cast(kinds.get(c.kind, "string")) for c in spec.columns if c.mandatory and c.name not in df.columns})


def keep_standard(df: DataFrame, spec: TableSpec) -> DataFrame:
    allowed = {*spec.names, ROW_SEQ}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in allowed])


def date_repairs(df: DataFrame, columns: list[str], source: str = "csv", strict: bool = True) -> dict[str, Column]:
    """What each of the columns that is text (or TIMESTAMP) becomes as DATE."""
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds.get(c) == "string"]
    found = {c: F.col(f"`{c}`").cast("date") for c in columns if (kinds.get(c) or "").startswith("timestamp")}
    if not text:
        return found
    if not strict:
        return found | {c: any_date(F.col(f"`{c}`")) for c in text}
    clean = df.agg(*[F.every(F.col(f"`{c}`").isNull() | iso_date(F.col(f"`{c}`")).isNotNull()).alias(c) for c in text]).first()
    return found | {c: iso_date(F.col(f"`{c}`")) if clean[c] in (True, None) else repaired(F.col(f"`{c}`"), source) for c in text}


def repair_dates(df: DataFrame, columns: list[str], source: str = "csv", strict: bool = True) -> DataFrame:
    """Text columns to DATE (and TIMESTAMP columns, without their time). ``strict``: one aggregate over the table decides, column by column, whether
    all values are ISO dates; if not, the column is yyyymmdd (``repaired``) and the rest becomes NULL. Not strict:
    every value by itself, without reading the table first."""
    return df.withColumns(date_repairs(df, columns, source, strict))


def blanks_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns if isinstance(kinds.get(c), T.StringType)})


#: What ``conform`` counts: rows, values per date column that are no dates (blanks and NA aren't counted), blanks per text column.
ROWS, IMPOSSIBLE, BLANK = "rows", "impossible dates in ", "blanks in "


def conform(df: DataFrame, spec: TableSpec, source: str = "csv", strict_dates: bool = True, notes: Diagnostics | None = None, counted: Observation | None = None) -> DataFrame:
    """``counted``: an observation in which the first job that reads the whole result finds ROWS, IMPOSSIBLE and BLANK counts; no job is added."""
    extra = [c for c in df.columns if c not in spec.names and c != ROW_SEQ]
    lacking = [c.name for c in spec.columns if c.mandatory and c.name not in df.columns]
    if notes is not None:
        for c in lacking:
            notes.add("info", spec.name, f"mandatory column {c} added")
        for c in extra:
            notes.add("info", spec.name, f"column {c} is not in the specification and was left out")
    df = keep_standard(df, spec)
    fixed = date_repairs(df, spec.of_kind("date"), source, strict_dates)
    if counted is not None:
        kinds = {f.name: f.dataType for f in df.schema}
        wrong = [F.count_if(present(F.col(f"`{c}`"), kinds[c]) & d.isNull()).alias(f"{IMPOSSIBLE}{c}") for c, d in fixed.items()]
        blank = [F.count_if(F.col(f"`{c}`") == "").alias(f"{BLANK}{c}") for c in spec.of_kind("text") if isinstance(kinds.get(c), T.StringType)]
        df = df.observe(counted, F.count(F.lit(1)).alias(ROWS), *wrong, *blank)
    return blanks_to_null(add_mandatory(df.withColumns(fixed), spec), spec.of_kind("text"))
