"""Concept records from source tables, by declarative rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.text import folded
from ..store import Store

#: Rules that one join broadcasts at most; more go without a hint.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """Rows of ``table`` in which every column of ``where`` has its value (compared in upper case) are records
    of ``concept_id``. ``value`` and ``date`` name columns to keep; without ``value`` a record says 'true'."""

    concept_id: str
    table: str
    where: tuple[tuple[str, str], ...]
    value: str | None = None
    date: str | None = None
    code: str | None = None

    def __post_init__(self):
        if not self.where or any(not c or v is None for c, v in self.where):
            raise ValueError(f"rule {self.concept_id}: every column has an expected value, and there is at least one")

    @property
    def signature(self) -> tuple[str, tuple[str, ...]]:
        return self.table, tuple(sorted({c for c, _ in self.where}))


# The columns of a wide map.
_COLUMN, _EXPECTED = re.compile(r"^column_name_(\w+)$"), "expected_value_"


def rules_from_wide(rows: DataFrame | Iterable[Mapping[str, Any]]) -> list[Rule]:
    """Rules from a map with a row each: column_name_1.. and expected_value_1.. are paired by their endings;
    pairs without a column (or 'NA') are left out, and a column without an expected value is an error."""
    if isinstance(rows, DataFrame):
        rows = [r.asDict() for r in rows.collect()]  # a map written by people
    none = lambda v: v is None or v in ("", "NA")
    rules = []
    for r in rows:
        pairs = []
        for name in r:
            m = _COLUMN.match(name)
            if m and not none(r[name]):
                expected = r.get(_EXPECTED + m[1])
                if none(expected):
                    raise ValueError(f"rule {r.get('concept_id')}: {r[name]} has no expected value")
                pairs.append((r[name], str(expected)))
        keep = lambda k: None if none(r.get(k)) else r[k]  # noqa: E731, B023
        rules.append(Rule(r["concept_id"], r["cdm_table_name"], tuple(pairs), keep("keep_value_column_name"), keep("keep_date_column_name"), keep("dap_spec_id")))
    if not rules:
        raise ValueError("the map has no rules")
    return rules


def _by_rule(df: DataFrame, columns: set[str], key: str, kind: str):
    """The column of the row whose name the rule gives, in one map lookup."""
    if not columns:
        return F.lit(None).cast(kind)
    make = (lambda c: iso_date(F.col(f"`{c}`").cast("string"))) if kind == "date" else (lambda c: F.col(f"`{c}`").cast("string"))
    entries = [x for c in sorted(columns) for x in (F.lit(c), make(c))]
    return F.try_element_at(F.create_map(*entries), F.col(key))


def extract_concepts(tables: Store | Mapping[str, DataFrame], rules: list[Rule], cutoff: str | None = None, meaning: bool = False, meaning_column: str | None = None, upper_values: bool = False, namespace: str | None = None) -> DataFrame:
    """ori_table, unique_id, person_id, code, coding_system, value, concept_id, date (, meaning).

    Rules with the same table and columns share one scan and one hash join, whatever their number: the
    rows' folded columns against the rules' expected values. A record may match several rules; it then has a
    row for each. ``cutoff`` (a date) applies to rules that keep a date, inclusive. ``upper_values``: kept
    values that are also matched come in upper case.
    """
    if not rules:
        raise ValueError("there are no rules")
    get = (lambda t: tables.get(t, namespace)) if isinstance(tables, Store) else tables.__getitem__
    groups: dict[tuple[str, tuple[str, ...]], list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.signature, []).append(r)
    parts = []
    for (table, columns), own in groups.items():
        df = get(table)
        wanted = {*columns, *(r.value for r in own if r.value), *(r.date for r in own if r.date), "ori_table", "unique_id", "person_id"}
        lacking = sorted(wanted - set(df.columns))
        if lacking:
            raise ValueError(f"{table} has no columns {lacking}")
        said = [c for c in df.columns if "meaning" in c]
        means = meaning_column if meaning_column in df.columns else said[0] if said else None
        names = [f"_expected_{k}" for k in range(len(columns))]
        listed = []
        for r in own:
            if len({(c, v.upper()) for c, v in r.where}) > len(columns):
                continue  # two values for one column: nothing can match
            by = dict(r.where)
            listed.append((r.concept_id, r.code, r.value, r.date, *[by[c] for c in columns]))
        spec = "_concept string, _code string, _value string, _date string, " + ", ".join(f"{n} string" for n in names)
        table_of_rules = df.sparkSession.createDataFrame(listed, spec).withColumns({n: F.upper(n) for n in names})
        if len(listed) <= BROADCAST_RULES:
            table_of_rules = F.broadcast(table_of_rules)
        match = reduce(and_, [folded(F.col(f"`{c}`")) == F.col(n) for c, n in zip(columns, names, strict=True)])
        value = _by_rule(df, {r.value for r in own if r.value}, "_value", "string")
        if upper_values:
            value = F.when(F.col("_value").isin(*columns), F.upper(value)).otherwise(value)
        joined = df.join(table_of_rules, match).withColumn("_when", _by_rule(df, {r.date for r in own if r.date}, "_date", "date"))
        if cutoff:
            joined = joined.where(F.col("_date").isNull() | (F.col("_when") >= F.lit(cutoff).cast("date")))
        out = [
            F.col("ori_table").cast("string").alias("ori_table"),
            F.col("unique_id").cast("string").alias("unique_id"),
            F.col("person_id").cast("string").alias("person_id"),
            F.col("_code").alias("code"),
            F.col("_code").alias("coding_system"),
            F.when(F.col("_value").isNull(), F.lit("true")).otherwise(value).alias("value"),
            F.col("_concept").alias("concept_id"),
            F.col("_when").alias("date"),
        ]
        if meaning:
            out.append((F.col(f"`{means}`").cast("string") if means else F.lit(None).cast("string")).alias("meaning"))
        parts.append(joined.select(*out))
    return reduce(DataFrame.unionByName, parts)
