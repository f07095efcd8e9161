"""Rewriting a dataset that is being read (K-2 where the output is the input).

Spark reads lazily, so a plain overwrite deletes the files its own plan still has to
read.  Here the new contents are written beside the dataset, and one rename commits them:

    path.new-<id>    being written; nobody reads it
    path.next        written whole and committed; this is the dataset now
    path             the dataset, once ``path.next`` has taken its place

A driver lost before the rename leaves the old dataset and a part to be swept away; one
lost after it leaves ``path.next``, which readers prefer and the next writer moves into
place.  So the dataset is always the old one or the new one, whole.  One writer at a time.
The rename must be atomic, as it is in HDFS and in local folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .io import path_exists, read_dataset, write_dataset


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = _fs(spark, old)
    if not fs.rename(source, _fs(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def current(spark: SparkSession, path: str) -> str:
    """Where the dataset's files are now."""
    path = path.rstrip("/")
    return f"{path}.next" if path_exists(spark, f"{path}.next") else path


def settle(spark: SparkSession, path: str) -> None:
    """Move a committed replacement, if there is one, to where the dataset belongs."""
    path = path.rstrip("/")
    if path_exists(spark, f"{path}.next"):
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        if fs.exists(p):
            raise OSError(f"cannot delete {path}")
        _rename(spark, f"{path}.next", path)


def sweep(spark: SparkSession, path: str) -> None:
    """Delete what writers that were lost left uncommitted."""
    fs, pattern = _fs(spark, f"{path.rstrip('/')}.new-*")
    for left in fs.globStatus(pattern) or []:
        fs.delete(left.getPath(), True)


def read_current(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """S-1 / S-2 on the dataset as last committed."""
    return read_dataset(spark, current(spark, path), schema, fmt=fmt)


def replace_dataset(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K-2: ``path`` holds the rows of ``df``, which may read ``path`` itself."""
    spark, path = df.sparkSession, path.rstrip("/")
    new = f"{path}.new-{uuid.uuid4().hex}"
    write_dataset(df, new, mode="error", fmt=fmt)
    settle(spark, path)  # of an earlier, lost writer; df has been read by now
    _rename(spark, new, f"{path}.next")
    settle(spark, path)
    sweep(spark, path)
