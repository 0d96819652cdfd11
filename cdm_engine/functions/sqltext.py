"""Table names in SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Strings, quoted names and comments, in which nothing is replaced; or one of the marks that stand for the step before.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?P<mark>%s|\{prev\})""", re.S)
PREVIOUS = "_previous_step"


def mark_previous(text: str) -> str:
    """``%s`` and ``{prev}``, where they stand for a table, become a name."""
    return _TOKEN.sub(lambda m: PREVIOUS if m["mark"] else m[0], text)


def _each(items: Any) -> list[Any]:
    return [items.apply(k) for k in range(items.size())]


def _tables(node: Any, hidden: frozenset[str], named: bool = False) -> Iterator[tuple[int, int, str, bool]]:
    """(first place, last place, name, whether it has an alias) of each table in a parsed plan; ``hidden``: names of common table
    expressions in whose scope the node is. Such an expression sees those before it, the query all of them."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        parts = [str(p) for p in _each(node.multipartIdentifier())]
        if len(parts) > 1 or parts[0].lower() not in hidden:
            yield node.origin().startIndex().get(), node.origin().stopIndex().get(), ".".join(parts), named
        return
    if kind == "UnresolvedWith":
        for definition in _each(node.innerChildren()):
            yield from _tables(definition, hidden)
            hidden |= {str(definition.alias()).lower()}
    for part in (*_each(node.children()), *_each(node.subqueries())):
        yield from _tables(part, hidden, kind == "SubqueryAlias")


def bind_tables(spark: SparkSession, text: str, find: Callable[[str], DataFrame | None]) -> DataFrame:
    """The result of SQL whose tables are DataFrames: ``find`` is asked for each table that Spark's parser finds in the
    text (parts of a name joined by dots); names that it doesn't know are left to the session's catalog."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    plain = lambda a, b: text[a:b].replace("{", "{{").replace("}", "}}")
    out, at = [], 0
    frames: dict[str, DataFrame] = {}
    for a, b, name, named in sorted(set(_tables(plan, frozenset()))):
        df = find(name)
        if df is not None:
            key = f"t{len(frames)}"
            frames[key] = df
            # columns may be qualified by the table's own name
            bare = named or re.search(r"\btable\s*$", text[at:a], re.I) or re.match(r"\s+tablesample\b", text[b + 1 :], re.I)
            alias = "" if bare else f" AS `{name.rsplit('.', 1)[-1]}`"
            out += [plain(at, a), f"{{{key}}}{alias}"]
            at = b + 1
    return spark.sql("".join([*out, plain(at, len(text))]), **frames)
