"""Folders and small files in any file system that Spark reaches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_FRESH: dict[str, SparkSession] = {}


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if it doesn't exist."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.isDirectory())


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file."""
    p, fs = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def get(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none if it doesn't exist."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else []))


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file to a name that nothing has yet; False if another writer had the name first. Readers see the whole
    file or none (wherever the file system's rename is atomic)."""
    jvm = spark._jvm
    (p, fs), (to, _) = _at(spark, source), _at(spark, target)
    p, to = fs.makeQualified(p), fs.makeQualified(to)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(p, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False


def move(spark: SparkSession, source: str, target: str) -> None:
    p, fs = _at(spark, source)
    to, _ = _at(spark, target)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{source} can't be moved to {target}")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)
    _FRESH.pop(path, None)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master (tests) may leave it unset; it then gets a
    temporary folder. On a cluster that would be another folder on every machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cdm_engine_")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes at the end of the program."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _FRESH[path] = spark
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows neither computes it again nor depends on one executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for path, spark in list(_FRESH.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except (Py4JError, OSError, AttributeError):  # the JVM may be gone at interpreter exit
            continue


atexit.register(_clean)
