"""Loading an instance's table files into a store."""

from __future__ import annotations

import csv
import io
from dataclasses import replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_text
from ..operators.conform import IMPOSSIBLE, Diagnostics, conform
from ..spec import TableSpec
from ..store import ROW_SEQ, Store, observed
from .discovery import choose
from .manifest import Version
from .records import ends_inside, records, relative, survey_blocks


def _first_record(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        text, inside = None, True
        while inside and (line := reader.readLine()) is not None:
            inside = ends_inside(line, text is not None)
            text = line if text is None else f"{text}\n{line}"
        return (text or "").lstrip("\ufeff")
    finally:
        reader.close()


def column_names(header: str) -> list[str]:
    """The fields of a header; one without a name is called by its place, names that repeat get their place behind them."""
    fields = next(csv.reader(io.StringIO(header, newline="")), [])
    fold = [f.lower() for f in fields]
    return [f"_c{k}" if not f else f"{f}{k}" if fold.count(f.lower()) > 1 else f for k, f in enumerate(fields)]


def _folder_uri(spark: SparkSession, folder: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getRawPath().rstrip("/")


def _order(file: Column, row: Column) -> Column:
    """Rows are ordered by the file's name below the instance's folder, then as they stand in the file, however files are split."""
    return F.struct(file.alias("file"), row.cast("long").alias("row")).alias(ROW_SEQ)


def read_csv(spark: SparkSession, paths: list[str], root: str, header: str, blocks: DataFrame) -> DataFrame:
    """Files with the same header below a folder (``root``, its path in URIs). All columns are text; NA is NULL and an empty field is ''.
    Adds the order of rows. Quoted fields may hold line ends; files are split between tasks all the same."""
    names = column_names(header)
    line = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    row = F.from_csv(line, ", ".join(f"c{k} string" for k in range(len(names))), {"escape": '"'}).alias("fields")
    parsed = records(spark, paths, root, blocks).where("row > 0").select("file", "row", row)  # the header is record 0
    return parsed.select(*[csv_text(F.col(f"fields.c{k}")).alias(n) for k, n in enumerate(names)], _order(F.col("file"), F.col("row")))


def read_parquet(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    raw = spark.read.option("mergeSchema", True).parquet(*paths)
    about = raw.metadataColumn("_metadata")  # a data column may have that name
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns], _order(relative(about.getField("file_path"), root), about.getField("row_index")))


def _aligned(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns whose types differ between files become text."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for c, k in p.dtypes:
            kinds.setdefault(c, set()).add(k)
    mixed = {c for c, k in kinds.items() if len(k) > 1 and c != ROW_SEQ}
    return [p.withColumns({c: F.col(f"`{c}`").cast("string") for c in p.columns if c in mixed}) for p in parts]


def read_files(spark: SparkSession, files: list[str], ext: str, folder: str) -> DataFrame:
    """One table of several files below a folder, matched by name: the first file's columns, then what others add.

    CSV files that begin with the same header are read together; a common reading of different ones would match columns by
    position. Parquet files are read together unless a column's types conflict.
    """
    root = _folder_uri(spark, folder)
    if ext == "csv":
        groups: dict[str, list[str]] = {}
        for f in files:
            groups.setdefault(_first_record(spark, f).rstrip("\r"), []).append(f)
        parts = [read_csv(spark, g, root, header, survey_blocks(spark, g, root)) for header, g in groups.items()]
    else:
        try:
            parts = [read_parquet(spark, files, root)]
        except (PySparkException, Py4JJavaError):  # types that do not merge
            parts = _aligned([read_parquet(spark, [f], root) for f in files])
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != ROW_SEQ], ROW_SEQ)


def load_tables(store: Store, folder: str, specs: dict[str, TableSpec], tables: list[str] | None = None, file_format: str = "auto", strict_dates: bool = True, save_to: str | None = None, notes: Diagnostics | None = None, commit: bool = True) -> Diagnostics:
    """Loads each table that has files and conforms it to its specification; others are noted and skipped.

    Tables are written as they are loaded to a folder ``save_to``, or, if the store is a database, to it: all of them in one new
    state. What conforming changed is counted by the job that writes a table (``notes.counts``); tables that aren't written count nothing. Without ``commit`` the versions
    that were written wait for the database's next commit."""
    notes = notes if notes is not None else Diagnostics()
    made: dict[str, Version] = {}
    for t in tables if tables is not None else list(specs):
        ext, files = choose(store.spark, folder, t, file_format)
        if not files:
            notes.add("warning", t, "no files")
            continue
        df, counted = read_files(store.spark, files, ext, folder), Observation(f"load {t}")
        if t in specs:
            df = conform(df, specs[t], ext, strict_dates, notes, counted if save_to or store.root else None)
        else:
            notes.add("warning", t, "not in the metadata; loaded as it is")
        if store.root and not save_to:
            made[t] = store.write(t, df)
        else:
            store.put(t, df)
            if save_to:
                store.save(t, save_to)
        if t in specs and (save_to or store.root):
            notes.counts[t] = observed(counted)
            for what, n in notes.counts[t].items():
                if n and what.startswith(IMPOSSIBLE):
                    notes.add("info", t, f"{what.removeprefix(IMPOSSIBLE)}: {n} values are no dates and became NULL")
            made |= {t: replace(made[t], counts=notes.counts[t])} if t in made else {}
    for t, version in made.items():
        store.put_written(t, version)
    if made and commit:
        store.commit(list(made))
    return notes
