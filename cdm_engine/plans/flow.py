"""Running configured operations in order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession

from ..operators.combine import row_counts
from ..operators.conform import Diagnostics
from ..operators.identity import assign_ids
from ..operators.quality import dedup_as_configured, dedup_split, drop_missing, side_folder
from ..sources.files import fresh_path
from ..sources.ingest import load_tables
from ..sources.manifest import Version
from ..sources.sinks import save_removed, write_report
from ..spec import Config, TableSpec, read_metadata
from ..store import ROW_SEQ, Store, observed


class Step(Protocol):
    """An operation on the tables of an engine."""

    def run(self, engine: Engine) -> None: ...


def pipeline_name(table: str, extension: str | None) -> str:
    return f"{table}{extension}" if extension else table


class RemoveDuplicates:
    def run(self, engine: Engine) -> None:
        c = engine.config.dedup
        for t, keys in c.columns.items():
            if not engine.has(t):
                continue
            columns = engine.store.columns(t)
            lacking = [k for k in keys if k not in columns] if keys != "*" else []
            if lacking:
                engine.notes.add("warning", t, f"has no columns {lacking}; duplicates were left")
            elif c.to_view:
                engine.store.add_step(pipeline_name(t, c.pipeline), lambda df: df.dropDuplicates([x for x in df.columns if x != ROW_SEQ]), t)
            elif c.save_deleted and c.save_path:
                self._split(engine, t, keys)
            else:
                engine.store.put(t, dedup_as_configured(engine.store.get(t), keys, False, c.save_deleted, c.save_path)[0])

    def _split(self, engine: Engine, table: str, keys: list[str] | str) -> None:
        """Kept and removed rows, written by one job; the kept ones are the table's next version as they lie."""
        c, store = engine.config.dedup, engine.store
        df, path = store.get(table), store.new_path(table)
        kept, removed, counts = dedup_split(df, keys, f"{store.root}/{path}" if store.root else fresh_path(store.spark, f"split-{table}"))
        if store.root and kept is not None:
            store.put_written(table, Version(f"{path}/{side_folder(True)}", df.schema.json(), counts))
        else:
            store.put(table, df.limit(0) if kept is None else kept)
        engine.notes.counts.setdefault(table, {}).update(counts)
        if removed is not None and (saved := save_removed(removed, c.save_path, table, c.postfix)):
            engine.notes.add("info", table, f"removed rows are in {saved}")


class RemoveMissing:
    def run(self, engine: Engine) -> None:
        c = engine.config.missing
        for t, columns in c.columns.items():
            if not engine.has(t):
                continue
            if not c.to_view:
                engine.store.put(t, drop_missing(engine.store.get(t), columns, engine.counting(t)))
                continue
            for x in columns:
                engine.store.add_step(pipeline_name(t, c.pipeline), lambda df, x=x: drop_missing(df, [x]), t)


class AssignIds:
    def run(self, engine: Engine) -> None:
        c = engine.config.ids
        for t in engine.config.tables:
            name = f"{t}{c.instance}"
            if not engine.has(name):
                continue
            if c.to_view:
                engine.store.add_step(pipeline_name(name, c.pipeline), lambda df, name=name: assign_ids(df, name), name)
            else:
                engine.store.put(name, assign_ids(engine.store.get(name), name))


class Report:
    def run(self, engine: Engine) -> None:
        c = engine.config.report
        path = write_report(row_counts(engine.store), c.path, c.name)
        engine.notes.add("info", "", f"row counts are in {path}")


#: The names of operations in configuration files.
STEPS: dict[str, type] = {"DuplicateRemover": RemoveDuplicates, "MissingRemover": RemoveMissing, "UniqueIdGenerator": AssignIds, "ReportGenerator": Report}


class Engine:
    """Configuration, specifications and tables of one instance.

    ``load`` reads its files; ``run`` does the configured operations that are switched on, in the order in which the
    configuration lists them, or a given list of steps. Unknown operations are noted and skipped.

    With a ``store`` that is opened on a folder a run is durable: loading and each step end with a state of the database that holds the tables
    they changed and an entry of the journal, together. A later run of the same configuration (``run_name`` tells runs apart
    that should not be one) goes on behind the last entry: it takes over the notes of finished steps and doesn't
    repeat them; steps that only add views are repeated, as they compute nothing. ``restart`` forgets the entries.
    """

    def __init__(self, spark: SparkSession, config: Config | str | Mapping[str, Any], metadata: Any = (), steps: Mapping[str, type] | None = None, store: Store | None = None, run_name: str = ""):
        self.config = config if isinstance(config, Config) else Config.of(config)
        specs_given = isinstance(metadata, Mapping) and all(isinstance(v, TableSpec) for v in metadata.values())
        self.specs: dict[str, TableSpec] = dict(metadata) if specs_given else read_metadata(metadata, spark)
        self.store, self.notes, self.steps = store or Store(spark), Diagnostics(), {**STEPS, **(steps or {})}
        said = json.dumps([run_name, asdict(self.config), {t: asdict(s) for t, s in self.specs.items()}], sort_keys=True)
        self.run_id = hashlib.sha256(said.encode()).hexdigest()[:16]
        self._counting: list[tuple[str, Observation]] = []

    def has(self, table: str) -> bool:
        if self.store.exists(table):
            return True
        self.notes.add("warning", table, "does not exist")
        return False

    def counting(self, table: str) -> Observation | None:
        """For a step to count in while its table is written; without a database nothing is written at a known time."""
        if not self.store.root:
            return None
        self._counting.append((table, Observation(f"{table} {len(self._counting)}")))
        return self._counting[-1][1]

    def restart(self) -> Engine:
        """The next load and run do everything again."""
        if self.store.root:
            self.store.commit([], forget=f"{self.run_id}/")
        return self

    def _finished(self, entry: str) -> bool:
        done = self.store.journal.get(entry)
        if done is None:
            return False
        self.notes.entries += [tuple(e) for e in done["notes"]]
        for t, counts in done["counts"].items():
            self.notes.counts.setdefault(t, {}).update(counts)
        return True

    def load(self, folder: str, save_to: str | None = None, strict_dates: bool = True) -> Engine:
        entry = f"{self.run_id}/load {folder}"
        if not self._finished(entry):
            before = len(self.notes.entries)
            load_tables(self.store, folder, self.specs, list(self.config.tables) or None, self.config.file_format, strict_dates, save_to, self.notes, commit=False)
            self._commit(entry, before, {})
        return self

    def _commit(self, entry: str, before: int, counts: dict[str, dict[str, int]]) -> None:
        """Writes what a step put, counts what it counts, and lists both with the journal's entry."""
        if not self.store.root:
            return
        made = self.store.write_unsaved()
        for t, o in self._counting:
            self.notes.counts.setdefault(t, {}).update(observed(o))
        self._counting.clear()
        changed = {t: c for t, c in self.notes.counts.items() if c != counts.get(t)}
        self.store.commit([], made, {entry: {"notes": self.notes.entries[before:], "counts": changed}})

    def planned(self) -> list[str]:
        return [name for name, on in self.config.operations.items() if on is True]

    def run(self, steps: list[Step] | None = None) -> Engine:
        named: list[tuple[str, Step]] = []
        if steps is None:
            for name in self.planned():
                if name in self.steps:
                    named.append((name, self.steps[name]()))
                else:
                    self.notes.add("warning", "", f"there is no operation {name}")
        else:
            named = [(type(s).__name__, s) for s in steps]
        for k, (name, step) in enumerate(named):
            entry = f"{self.run_id}/{k} {name}"
            if self._finished(entry):
                continue
            before, views, counts = len(self.notes.entries), self.store.pipelines(), {t: dict(c) for t, c in self.notes.counts.items()}
            step.run(self)
            if self.store.pipelines() == views:
                self._commit(entry, before, counts)
        return self

    def table(self, name: str) -> DataFrame:
        return self.store.get(name).drop(ROW_SEQ)
