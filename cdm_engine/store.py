"""A catalog of versioned tables and view pipelines, in memory or in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

from .functions.sqltext import PREVIOUS, bind_tables, mark_previous
from .sources.files import delete
from .sources.manifest import Manifest, State, Version, as_json, catalog_name

Transform = Callable[[DataFrame], DataFrame]
#: The order in which rows were loaded; not a data column.
ROW_SEQ = "_row_seq"


def observed(observation: Observation) -> dict[str, int]:
    """What was counted by a job that has ended; nothing if the optimizer found that no row passes."""
    try:
        return {k: v or 0 for k, v in observation.get.items()}
    except Py4JJavaError:
        return {}


class Store:
    """Names to DataFrames, by namespace. Putting a table adds a version; earlier ones stay readable.

    Tables of an attached namespace are addressed as ``alias.table``. Nothing is computed until an action
    asks for it; ``save`` writes a version as parquet and reads it back, so that what follows is stable.

    A store that is opened on a folder (``root``) is a database: saved versions and SQL pipelines are listed in its manifest, and another
    session that opens the folder, or attaches it under an alias, finds them, older versions as well. What is only put belongs
    to the session. A version appears whole or not at all (``sources/manifest.py``); of sessions that save at the same time none loses its version.
    """

    MAIN = "main"

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self._tables: dict[tuple[str, str], list[DataFrame | Version]] = {}
        self._unsaved: dict[str, DataFrame | Version] = {}
        self._heads: dict[str, str] = {}
        self._views: dict[str, DataFrame] = {}
        self._steps: dict[str, list[dict[str, str | None]] | None] = {}
        self._manifest = Manifest(spark, root) if root else None
        self._journal: dict[str, Any] = {}
        self._layouts: dict[tuple[str, str], dict[str, Any] | None] = {}
        if self._manifest:
            self._follow(self._manifest.state())

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """The database in a folder, which may be new."""
        return cls(spark, root)

    @property
    def root(self) -> str | None:
        return self._manifest.root if self._manifest else None

    def _key(self, name: str, namespace: str | None) -> tuple[str, str]:
        if namespace is None and "." in name and (self.MAIN, name) not in self._tables:
            namespace, name = name.split(".", 1)
        return namespace or self.MAIN, name

    def put(self, name: str, df: DataFrame, namespace: str | None = None) -> DataFrame:
        key = self._key(name, namespace)
        self._tables.setdefault(key, []).append(df)
        if key[0] == self.MAIN:
            self._unsaved[key[1]] = df
        return df

    def put_written(self, name: str, version: Version) -> DataFrame:
        """A version whose data are below the database's root already; the next commit lists it."""
        df = self.put(name, version.frame(self.spark, self._manifest.root))
        self._unsaved[name] = version
        return df

    def get(self, name: str, namespace: str | None = None, version: int = -1) -> DataFrame:
        if namespace is None and name in self._views:
            return self._views[name]
        key = self._key(name, namespace)
        if key not in self._tables:
            raise KeyError(f"no table {'.'.join(key)}")
        found = self._tables[key]
        if isinstance(found[version], Version):  # read when it is asked for
            found[version] = found[version].frame(self.spark, self._manifest.root)
        return found[version]

    def versions(self, name: str, namespace: str | None = None) -> int:
        return len(self._tables.get(self._key(name, namespace), ()))

    def exists(self, name: str, namespace: str | None = None) -> bool:
        return (namespace is None and name in self._views) or self._key(name, namespace) in self._tables

    def columns(self, name: str, namespace: str | None = None) -> list[str]:
        return [c for c in self.get(name, namespace).columns if c != ROW_SEQ]

    def names(self, namespace: str | None = None, views: bool = True) -> list[str]:
        own = [t for n, t in self._tables if n == (namespace or self.MAIN)]
        return own + (list(self._views) if views and namespace is None else [])

    def drop(self, name: str, namespace: str | None = None) -> None:
        """A database forgets a saved table in its next state; the data stay for who reads an older one."""
        key = self._key(name, namespace)
        saved = self._manifest and key[0] == self.MAIN and name in self._manifest.state()["tables"]
        self._tables.pop(key, None)
        self._unsaved.pop(name, None)
        self._views.pop(name, None)
        if saved:
            self._manifest.commit(lambda s: s["tables"].pop(name, None))

    def attach(self, alias: str, source: Store | Mapping[str, DataFrame] | str) -> None:
        """Tables under an alias: those of another store, of a mapping, or of the database in a folder as it is now (pipelines
        included). They are read only."""
        if isinstance(source, str):
            source = Store.open(self.spark, source)
        tables = {t: source.get(t) for t in source.names()} if isinstance(source, Store) else source
        for t, df in tables.items():
            self._tables.setdefault((alias, t), []).append(df)
            self._layouts[alias, t] = source.layout(t) if isinstance(source, Store) else None

    # -- saved versions

    def save(self, name: str, root: str | None = None, namespace: str | None = None) -> DataFrame:
        """Writes the newest version to a path of its own (never the one it is read from): in the database, or in another folder ``root``."""
        df = self.get(name, namespace)
        key = self._key(name, namespace)
        if root is None and self._manifest:
            if key[0] != self.MAIN:
                raise ValueError(f"{'.'.join(key)} is attached; only tables of the database itself are saved in it")
            self._unsaved[key[1]] = df
            self.commit([key[1]])
            return self.get(*reversed(key))
        if root is None:
            raise ValueError("a store that isn't opened on a folder saves to one that is named")
        path = f"{root.rstrip('/')}/{'.'.join(key)}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._saved(key, self.spark.read.schema(df.schema).parquet(path))

    def _saved(self, key: tuple[str, str], df: DataFrame) -> DataFrame:
        self._tables.setdefault(key, []).append(df)
        if key[0] == self.MAIN:
            self._unsaved.pop(key[1], None)
        return df

    def new_path(self, name: str) -> str:
        """Where a new version of a table can be written: below the database's root."""
        return f"data/{name}/{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, layout: dict[str, Any] | None = None) -> Version:
        """Data of a new version, which ``commit`` makes one. ``layout``: see ``Version``; rows of a bucket are brought together by one shuffle."""
        path = self.new_path(name)
        place, schema = f"{self._manifest.root}/{path}", df.schema.json()
        if not layout:
            df.write.parquet(place)
            return Version(path, schema)
        blooms = {f"parquet.bloom.filter.{k}#{c}": "true" for c in layout["lookups"] for k in ("enabled", "adaptive.enabled")}
        columns, buckets = layout["columns"], layout["buckets"]
        if buckets:
            out = df.repartition(buckets, *columns).write.options(**blooms).bucketBy(buckets, *columns).sortBy(*columns)
            out.option("path", place).format("parquet").saveAsTable(catalog_name(self._manifest.root, path))
        else:
            df.sortWithinPartitions(*columns).write.options(**blooms).parquet(place)
        return Version(path, schema, None, layout)

    def layout(self, name: str) -> dict[str, Any] | None:
        """How a table's newest version is laid out, if it is saved in the database (or attached from one)."""
        key = self._key(name, None)
        if name in self._views or key[0] == self.MAIN and name in self._unsaved:
            return None
        return self._layouts.get(key)

    def write_unsaved(self, names: list[str] | None = None) -> dict[str, Version]:
        """Data of what is put and unsaved (of those of ``names``), for ``commit`` to list."""
        own = {n: v for n, v in self._unsaved.items() if names is None or n in names}
        return {n: v if isinstance(v, Version) else self.write(n, v) for n, v in own.items()}

    def commit(self, names: list[str] | None = None, made: Mapping[str, Version] | None = None, journal: Mapping[str, Any] | None = None, forget: str | None = None) -> None:
        """Saves what is put and unsaved (or those of ``names``), and versions written before (``made``), in one state of the database;
        ``journal``: entries to keep beside them; ``forget``: the beginning of entries that go."""
        if not self._manifest:
            raise ValueError("only a store that is opened on a folder can commit")
        made = dict(made or {})
        made |= self.write_unsaved([n for n in (self._unsaved if names is None else names) if n not in made])

        def change(state: State) -> None:
            for n, v in made.items():
                state["tables"].setdefault(n, []).append(as_json(v))
            state["journal"] = {k: v for k, v in state["journal"].items() if forget is None or not k.startswith(forget)} | dict(journal or {})
            state["pipelines"].update({p: s for p, s in self._steps.items() if s})

        state = self._manifest.commit(change)
        for n in made:
            self._unsaved.pop(n, None)
        self._follow(state)

    def _follow(self, state: State) -> None:
        """Takes over a state. What is put and unsaved stays the newest version."""
        for t, listed in self._manifest.versions(state).items():
            self._layouts[self.MAIN, t] = listed[-1].layout
            last = [self._tables[self.MAIN, t][-1]] if t in self._unsaved else []
            self._tables[self.MAIN, t] = [*listed, *last]
        for t in [t for n, t in self._tables if n == self.MAIN and t not in state["tables"] and t not in self._unsaved]:
            del self._tables[self.MAIN, t]
        self._journal = state["journal"]
        for pipeline, steps in state["pipelines"].items():
            if pipeline not in self._heads:
                for s in steps:
                    self._add(pipeline, s["sql"], s["base"])

    def refresh(self) -> None:
        """What other sessions have saved since."""
        self._follow(self._manifest.state())

    @property
    def journal(self) -> dict[str, Any]:
        return dict(self._journal)

    def saved_version(self, name: str, version: int = -1) -> Version:
        """Path, schema, counts and layout of a saved version."""
        return self._manifest.versions(self._manifest.state())[name][version]

    def expire(self, name: str, keep: int = 1) -> int:
        """Forgets all saved versions of a table but the newest ``keep`` and deletes their data; how many. Whoever still reads
        them fails, so this is for times when nobody does."""
        gone: list[Version] = []

        def change(state: State) -> None:
            listed = state["tables"].get(name, [])
            gone[:] = [Version(**v) for v in listed[:-keep]]
            state["tables"][name] = listed[-keep:]

        if keep < 1:
            raise ValueError("at least one version is kept; drop forgets a table")
        self._follow(self._manifest.commit(change))
        for v in gone:
            delete(self.spark, f"{self._manifest.root}/{v.path}")
        return len(gone)

    # -- pipelines of views

    def _find(self, name: str) -> DataFrame | None:
        """A table, view or pipeline by its name in SQL: as it is, else the only one that differs in case."""
        if self.exists(name):
            return self.get(name)
        every = [t if n == self.MAIN else f"{n}.{t}" for n, t in self._tables] + list(self._views)
        alike = [n for n in every if n.lower() == name.lower()]
        return self.get(alike[0]) if len(alike) == 1 else None

    def sql(self, text: str) -> DataFrame:
        """A query over tables, views, pipelines and attached tables (``alias.table``) by their names."""
        return bind_tables(self.spark, text, self._find)

    def add_step(self, pipeline: str, transform: Transform | str, base: str | None = None) -> str:
        """Adds a lazy step: a function, or SQL in which ``{prev}`` (or ``%s``) stands for the step before and every other table of the store,
        pipelines included, is called by its name. The first step needs ``base``, a table; later ones ignore it. Step n is the view
        ``<pipeline>_view_<n>``; the pipeline's own name always means its last step. In a database a pipeline whose steps are all SQL is
        kept with the next commit."""
        name = self._add(pipeline, transform, base)
        steps = self._steps.setdefault(pipeline, [])
        if isinstance(transform, str) and steps is not None:
            steps.append({"sql": transform, "base": base})
        else:
            self._steps[pipeline] = None  # functions aren't kept
        return name

    def _add(self, pipeline: str, transform: Transform | str, base: str | None) -> str:
        head = self._heads.get(pipeline)
        if head is None:
            if base is None:
                raise ValueError(f"the first step of {pipeline} needs a base table")
            previous, n = self.get(base), 1
        else:
            previous, n = self._views[head], int(head.rsplit("_", 1)[1]) + 1
        name = f"{pipeline}_view_{n}"
        if callable(transform):
            df = transform(previous)
        else:
            df = bind_tables(self.spark, mark_previous(transform), lambda t: previous if t == PREVIOUS else self._find(t))
        self._views[name] = self._views[pipeline] = df
        self._heads[pipeline] = name
        return name

    def pipelines(self) -> dict[str, str]:
        """Pipeline names and the views that are their last steps."""
        return dict(self._heads)
