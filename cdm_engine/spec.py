"""Table specifications and run configuration."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ColumnSpec:
    """``kind``: 'text' (blanks become NULL), 'date' (text is repaired to DATE) or 'other'."""

    name: str
    mandatory: bool = False
    kind: str = "text"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def of_kind(self, kind: str) -> list[str]:
        return [c.name for c in self.columns if c.kind == kind]


# The metadata table's column names and the words that its cells contain.
TABLE, VARIABLE, MANDATORY, FORMAT = "TABLE", "Variable", "Mandatory", "Format"
YES, DATE_FORMAT, TEXT_FORMAT = "Yes", "yyyymmdd", "Character"


def _kind(fmt: str) -> str:
    return "date" if DATE_FORMAT in fmt else "text" if TEXT_FORMAT in fmt else "other"


def read_metadata(source: DataFrame | str | Iterable[Mapping[str, Any]], spark: SparkSession | None = None) -> dict[str, TableSpec]:
    """Specifications by table name, from a DataFrame, rows, or the path of a CSV, JSON or parquet file
    with the columns TABLE, Variable, Mandatory and Format. (R's own format has no reader here.)"""
    if isinstance(source, str):
        if spark is None:
            raise ValueError("reading metadata from a path needs a session")
        ext = source.rsplit(".", 1)[-1].lower()
        if ext not in ("csv", "json", "parquet"):
            raise ValueError(f"metadata can be read from csv, json or parquet, not {ext!r}")
        source = spark.read.option("header", True).csv(source) if ext == "csv" else getattr(spark.read, ext)(source)
    if isinstance(source, DataFrame):
        lacking = {TABLE, VARIABLE, MANDATORY, FORMAT} - set(source.columns)
        if lacking:
            raise ValueError(f"metadata lacks {sorted(lacking)}")
        rows: list[Mapping[str, Any]] = [r.asDict() for r in source.select(TABLE, VARIABLE, MANDATORY, FORMAT).collect()]
    else:
        rows = list(source)
    found: dict[str, list[ColumnSpec]] = {}
    for r in rows:
        found.setdefault(r[TABLE], []).append(ColumnSpec(r[VARIABLE], YES in (r[MANDATORY] or ""), _kind(r[FORMAT] or "")))
    return {t: TableSpec(t, tuple(c)) for t, c in found.items()}


@dataclass(frozen=True)
class DedupConfig:
    columns: dict[str, list[str] | str] = field(default_factory=dict)
    save_path: str | None = None
    postfix: str | None = None
    save_deleted: bool = False
    to_view: bool = False
    pipeline: str | None = None


@dataclass(frozen=True)
class MissingConfig:
    columns: dict[str, list[str]] = field(default_factory=dict)
    to_view: bool = False
    pipeline: str | None = None


@dataclass(frozen=True)
class IdConfig:
    instance: str = ""
    to_view: bool = False
    pipeline: str | None = None


@dataclass(frozen=True)
class ReportConfig:
    path: str = "."
    name: str = ""


@dataclass(frozen=True)
class Config:
    """A run: which tables, in which file format, and which operations in which order."""

    tables: tuple[str, ...] = ()
    file_format: str = "auto"
    operations: dict[str, bool] = field(default_factory=dict)
    dedup: DedupConfig = DedupConfig()
    missing: MissingConfig = MissingConfig()
    ids: IdConfig = IdConfig()
    report: ReportConfig = ReportConfig()

    @classmethod
    def of(cls, source: str | Mapping[str, Any]) -> Config:
        """From a JSON file's path or its parsed content. The keys are fixed values of the file format."""
        if isinstance(source, str):
            with open(source, encoding="utf-8") as f:
                source = json.load(f)
        part = lambda key: source.get(key) or {}
        d, m, u, r = part("duplicate_remover"), part("missing_remover"), part("unique_id_generator"), part("report_generator")
        return cls(
            tables=tuple(source.get("cdm_tables_names") or ()),
            file_format=source.get("file_format") or "auto",
            operations=dict(part("operations")),
            dedup=DedupConfig(dict(d.get("cdm_tables_columns") or {}), d.get("save_path"), d.get("add_postfix"), bool(d.get("save_deleted")), bool(d.get("to_view")), d.get("pipeline_extension")),
            missing=MissingConfig(dict(m.get("columns") or {}), bool(m.get("to_view")), m.get("pipeline_extension")),
            ids=IdConfig(u.get("instance_name") or "", bool(u.get("to_view")), u.get("pipeline_extension")),
            report=ReportConfig(r.get("report_path") or ".", r.get("report_name") or ""),
        )
