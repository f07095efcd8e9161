"""An index of the keys that earlier runs have kept (J-1, J-4, SET-4).

New rows are usually few and history is long, so an anti join that shuffles history
every run costs more each time.  The index is kept up run by run instead:

    <path>/keys/increment=<id>/bucket=<b>/    the keys added by one run, sorted
    <path>/filters/                           one Bloom filter per increment and slice of a bucket

``unseen`` asks the filters first.  A key that no filter knows is new, and history is not read
for it; for the others (real repeats and about one in a hundred of the rest) the keys of their
buckets alone are read, which shows in the plan as a partition filter, and compared exactly.

An increment counts once its filters are written, so a run lost half way has added nothing.
Filters hold ``BITS`` bits a key.  A task probes one slice of the keys against the filters of
that slice, one per run, so neither history nor a large batch of new rows meets in one task;
an index for more keys takes more slices.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .io import path_exists

BUCKETS, SLICES = 256, 4096
BITS, PROBES = 10, 7
FILTERS = "increment string, slice int, bits binary"


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each 64-bit hash in a filter of ``size`` bits, one row per probe."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(size) for i in range(PROBES)])


def bloom(hashes: np.ndarray) -> bytes:
    size = 8 * max(8, -(-len(hashes) * BITS // 8))
    bits = np.zeros(size, np.uint8)
    bits[positions(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def knows(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash; False is certain."""
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[positions(hashes, len(bits))].all(axis=0)


def hashed(keys: DataFrame, key: str, buckets: int, slices: int) -> DataFrame:
    """key, hash, slice and bucket of the distinct keys; slices are parts of a bucket."""
    if slices % buckets:
        raise ValueError("a bucket is a whole number of slices")
    own = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().withColumn("hash", F.xxhash64("key"))
    cut = own.withColumn("slice", F.pmod("hash", F.lit(slices)).cast("int"))
    return cut.withColumn("bucket", (F.col("slice") % buckets).cast("int"))


def add_keys(keys: DataFrame, key: str, path: str, buckets: int = BUCKETS, slices: int = SLICES) -> None:
    """Add the distinct non-null keys of one run to the index at ``path``."""
    spark, increment = keys.sparkSession, uuid.uuid4().hex
    at = f"{path}/keys/increment={increment}"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (hashed(keys, key, buckets, slices).repartitionByRange(width, "bucket", "key").sortWithinPartitions("bucket", "key")
     .write.partitionBy("bucket").parquet(at))
    write_filters(spark.read.schema("hash long, slice int").parquet(at), increment, path)


def write_filters(added: DataFrame, increment: str, path: str) -> None:
    """The filters of an increment's keys; with them it counts."""
    def build(table: pa.Table) -> pa.Table:
        return pa.table({"increment": [increment], "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()),
                         "bits": pa.array([bloom(table.column("hash").to_numpy())], pa.binary())})

    added.groupBy("slice").applyInArrow(build, FILTERS).write.mode("append").parquet(f"{path}/filters")


def filters(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/filters"):
        return spark.createDataFrame([], FILTERS)
    return spark.read.schema(FILTERS).parquet(f"{path}/filters")


def suspects(rows: DataFrame, key: str, path: str, buckets: int = BUCKETS, slices: int = SLICES) -> DataFrame:
    """key, bucket of the distinct keys of ``rows`` that some filter knows."""
    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        hashes = asked.column("hash").to_numpy()
        known = np.zeros(len(hashes), bool)
        for bits in held.column("bits"):
            known |= knows(bits.as_py(), hashes)
        return asked.filter(pa.array(known)).select(["key", "bucket"])

    asked = hashed(rows, key, buckets, slices)
    held = filters(rows.sparkSession, path)
    return asked.groupBy("slice").cogroup(held.groupBy("slice")).applyInArrow(probe, "key string, bucket int")


def unseen(rows: DataFrame, key: str, path: str, buckets: int = BUCKETS, slices: int = SLICES) -> DataFrame:
    """The rows whose key no run has added (rows without a key stay, as in an anti join)."""
    spark = rows.sparkSession
    maybe = staged(suspects(rows, key, path, buckets, slices), "history-suspects")
    if maybe.isEmpty():
        return rows
    seen = maybe.join(history(spark, path, maybe), ["bucket", "key"], "left_semi").select(F.col("key").alias("_seen"))
    return rows.join(seen, F.col(key) == F.col("_seen"), "left_anti")


def history(spark: SparkSession, path: str, maybe: DataFrame) -> DataFrame:
    """The keys of all increments that count, of the buckets of ``maybe`` only."""
    buckets = sorted(r.bucket for r in maybe.select("bucket").distinct().collect())  # at most BUCKETS
    counted = filters(spark, path).select("increment").distinct()
    keys = spark.read.schema("key string, increment string, bucket int").parquet(f"{path}/keys")
    return keys.where(F.col("bucket").isin(buckets)).join(F.broadcast(counted), "increment", "left_semi")  # a row per run
