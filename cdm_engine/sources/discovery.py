"""Finding a table's files, in any file system that Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession

FORMATS = ("csv", "parquet")


def list_files(spark: SparkSession, folder: str, table: str, ext: str) -> list[str]:
    """``<folder>/<table>*.<ext>``, not below the folder, sorted by name. A CSV folder of that name, as Spark writes it,
    stands for its parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{table}*.{ext}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(path) or [])
    if ext == "csv":
        found = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
        found = [f for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(f.getPath().toString() for f in found)


def choose(spark: SparkSession, folder: str, table: str, file_format: str = "auto") -> tuple[str, list[str]]:
    """(format, files). ``auto`` prefers parquet; a table is read in one format. No files: an empty list."""
    if file_format not in (*FORMATS, "auto"):
        raise ValueError(f"file format is one of {(*FORMATS, 'auto')}, not {file_format!r}")
    for ext in ("parquet", "csv") if file_format == "auto" else (file_format,):
        files = list_files(spark, folder, table, ext)
        if files:
            return ext, files
    return (file_format if file_format != "auto" else "parquet"), []
