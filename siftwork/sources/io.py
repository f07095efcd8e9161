"""Dataset sources and sinks (S-1, S-2, K-1, K-2, K-3, K-7).

Datasets are JSON-lines (or parquet) folders: many files, read in parallel.
A single pretty-printed JSON array (the reference layout) is still readable
with ``multiline=True`` but is then one task per file, so large sets should be
written as JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def holds_nothing(spark: SparkSession, path: str, fmt: str) -> bool:
    if fmt == "json":
        return spark.read.text(path).isEmpty()
    return spark.read.parquet(path).isEmpty()


def read_dataset(spark: SparkSession, path: str, schema: StructType, multiline: bool = False,
                 fmt: str = "json") -> DataFrame:
    """S-1 + S-2: typed read with an explicit schema; a missing path is an
    empty dataset; malformed JSON records surface in ``_corrupt_record``."""
    full = schema if fmt == "parquet" else StructType(schema.fields + [StructField(CORRUPT, StringType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (spark.read.schema(full).option("multiLine", multiline).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    """K-1 (UTF-8 JSON lines, no ASCII escaping), K-2 (overwrite / append),
    K-3 (append one increment), K-7 (``mode='ignore'``: keep a non-empty output)."""
    if mode == "ignore":
        # an output without records is no output yet
        if path_exists(df.sparkSession, path) and not holds_nothing(df.sparkSession, path, fmt):
            return
        mode = "overwrite"
    w = df.write.mode(mode)
    if fmt == "json":
        w.option("encoding", "UTF-8").json(path)
    else:
        w.parquet(path)


def write_observed(df: DataFrame, path: str, stats: list[Column], keep: Column | None = None, mode: str = "error",
                   fmt: str = "json") -> DataFrame:
    """Write a dataset (the rows that ``keep`` holds for) and take the statistics of all of
    ``df`` from the same pass (A-7, A-9, A-10): one row of the aggregates ``stats``, which
    the writing tasks keep as they go, so neither the work behind ``df`` nor the written files
    are read again."""
    spark, seen = df.sparkSession, Observation()
    told = df.observe(seen, *stats)
    write_dataset(told if keep is None else told.where(keep), path, mode=mode, fmt=fmt)
    schema = df.limit(0).agg(*stats).schema
    return spark.createDataFrame([tuple(seen.get[f.name] for f in schema)], schema)


def read_json_documents(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """S-1 on documents (one JSON array per file): the entries of the arrays, and
    one report row per file that is no JSON array of objects, with the reason."""
    docs = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), "value", F.try_parse_json("value").alias("_v"))
    array = F.try_variant_get("_v", "$", "array<variant>")
    reason = F.when(F.col("_v").isNull(), "not JSON").when(array.isNull(), "not an array").when(
        F.exists(array, lambda e: ~F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False))),
        "an entry is not an object")
    told = docs.withColumn("reason", reason)
    good = told.where(F.col("reason").isNull()).select(F.explode(F.from_json("value", ArrayType(schema))).alias("e"))
    return good.select("e.*"), told.where(F.col("reason").isNotNull()).select("file", "reason")


def append_increment(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K-3: add records to an existing dataset without rewriting it."""
    write_dataset(df, path, mode="append", fmt=fmt)
