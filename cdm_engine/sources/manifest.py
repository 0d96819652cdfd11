"""Which versions of which tables a database folder holds.

``<root>/_versions/<number>.json`` is the whole state after that many commits; the highest number is the state. A commit writes its
file under another name and renames it to the next number, which only one writer can do: readers see the state before or
after it and nothing between, and a writer that comes second repeats its change upon the state of the first. Table data is
written to folders of its own before; what a writer left behind that never committed is in no state.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .files import delete, get, names, publish, put

#: State files that stay.
KEPT = 100


@dataclass(frozen=True)
class Version:
    """One version of a table: its folder below the root, its schema, what was counted while it was written, and how it is laid out
    (``columns`` it is sorted by in each file, ``buckets``, and ``lookups``, the columns with bloom filters)."""

    path: str
    schema: str
    counts: dict[str, int] | None = None
    layout: dict[str, Any] | None = None

    def frame(self, spark: SparkSession, root: str) -> DataFrame:
        """Reads it. Spark knows the buckets of tables of its catalog only, so a bucketed version is entered there (its data stay where they are)."""
        schema = T.StructType.fromJson(json.loads(self.schema))
        if not (self.layout and self.layout["buckets"]):
            return spark.read.schema(schema).parquet(f"{root}/{self.path}")
        name, fields = catalog_name(root, self.path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{c}`" for c in self.layout["columns"])
        place = f"{root}/{self.path}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.layout['buckets']} BUCKETS LOCATION '{place}'")
        return spark.table(name)


def catalog_name(root: str, path: str) -> str:
    return f"version_{hashlib.sha256(f'{root}/{path}'.encode()).hexdigest()[:24]}"


State = dict[str, Any]


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_versions"

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def state(self, number: int | None = None) -> State:
        """The newest state (or that after so many commits). Before any commit it is empty."""
        while True:
            numbers = self._numbers()
            if number is None and not numbers:
                return {"number": 0, "tables": {}, "pipelines": {}, "journal": {}}
            if number is not None and number not in numbers:
                raise KeyError(f"{self.root} has no state {number}")
            try:
                return json.loads(get(self.spark, self._file(numbers[-1] if number is None else number)))
            except Exception:
                if self._numbers() == numbers:  # else it was tidied away meanwhile
                    raise

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def commit(self, change: Callable[[State], None]) -> State:
        """Applies ``change`` to the newest state and makes the result the next one."""
        while True:
            state = self.state()
            change(state)
            state["number"] += 1
            draft = f"{self.folder}/.{uuid.uuid4().hex}"
            put(self.spark, draft, json.dumps(state).encode())
            if publish(self.spark, draft, self._file(state["number"])):
                for n in self._numbers()[:-KEPT]:
                    delete(self.spark, self._file(n))
                return state
            delete(self.spark, draft)

    def versions(self, state: State) -> dict[str, list[Version]]:
        return {t: [Version(**v) for v in listed] for t, listed in state["tables"].items()}


def as_json(version: Version) -> dict[str, Any]:
    return asdict(version)
