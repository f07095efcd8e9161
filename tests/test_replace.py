"""A dataset that is replaced is the old one or the new one, whole, whenever a driver is lost."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.sources import replace as R

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])


def ids(spark, path, fmt="json"):
    return sorted(r.id for r in R.read_current(spark, path, SCHEMA, fmt).collect())


def table(spark, *values):
    return spark.createDataFrame([(v, str(v)) for v in values], SCHEMA)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_reads_and_replaces_its_own_path(spark, tmp_path, fmt):
    path = str(tmp_path / "d")
    R.replace_dataset(table(spark, 1, 2, 3), path, fmt)
    stored = R.read_current(spark, path, SCHEMA, fmt).select("id", "s")
    R.replace_dataset(stored.where("id > 1").unionByName(stored.withColumn("id", F.col("id") + 10)), path, fmt)
    assert ids(spark, path, fmt) == [2, 3, 11, 12, 13] and os.listdir(tmp_path) == ["d"]


def test_lost_while_writing(spark, tmp_path):
    path = str(tmp_path / "d")
    R.replace_dataset(table(spark, *range(100)), path)
    stored = R.read_current(spark, path, SCHEMA).select("id", "s")
    fails = F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("s"))
    with pytest.raises(Exception, match="lost"):
        R.replace_dataset(stored.withColumn("s", fails), path)
    assert ids(spark, path) == list(range(100))
    (tmp_path / "d.new-left").mkdir()
    R.replace_dataset(stored.where("id < 3"), path)
    assert ids(spark, path) == [0, 1, 2] and os.listdir(tmp_path) == ["d"]


@pytest.mark.parametrize("old_files_gone", [False, True])
def test_lost_after_the_commit(spark, tmp_path, monkeypatch, old_files_gone):
    path = str(tmp_path / "d")
    R.replace_dataset(table(spark, 1, 2), path)
    settle, calls = R.settle, []

    def lost(session, p):
        calls.append(p)
        if len(calls) == 2:
            if old_files_gone:
                fs, at = R._fs(session, p)
                fs.delete(at, True)
            raise KeyboardInterrupt
        settle(session, p)

    monkeypatch.setattr(R, "settle", lost)
    with pytest.raises(KeyboardInterrupt):
        R.replace_dataset(table(spark, 7, 8, 9), path)
    monkeypatch.undo()
    assert ids(spark, path) == [7, 8, 9]
    stored = R.read_current(spark, path, SCHEMA).select("id", "s")
    R.replace_dataset(stored.where("id > 7"), path)
    assert ids(spark, path) == [8, 9] and os.listdir(tmp_path) == ["d"]


def test_nothing_yet(spark, tmp_path):
    path = str(tmp_path / "none")
    assert ids(spark, path) == []
    R.replace_dataset(table(spark), path)
    assert ids(spark, path) == []
