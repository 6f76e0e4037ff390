"""Tables that a session keeps: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, object] = {}


def workspace(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary
    folder, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """df written, and read again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that keep() wrote and nothing reads any more."""
    if path := getattr(df, "_kept_at", None):
        delete(df.sparkSession, path)


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What make() gave when key was first asked for in this application."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _KEPT:
        _KEPT[k] = make()
    return _KEPT[k]


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for a path of any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, put in place by a rename that replaces what is there, so
    readers see the old text or the new."""
    fs, p = filesystem(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(part), fs.makeQualified(p), how)


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file that must not exist yet: it is whole before it gets its
    name, and a file of that name is an error."""
    fs, p = filesystem(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(part), fs.makeQualified(p), how)
    except Exception as e:
        fs.delete(part, False)
        raise FileExistsError(f"cannot create {path}: {e}") from e


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none. Other errors are raised."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]
