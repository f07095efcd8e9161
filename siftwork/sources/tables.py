"""Input tables: one parquet dataset per table under a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; projections and filters applied later reach the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


VIEW_PREFIX = "__siftwork_"


def private_view(name: str) -> str:
    """Session temp-view name used for ``name`` (never a caller's view name)."""
    return f"{VIEW_PREFIX}{name}"


def private_sql(sql: str) -> str:
    """Point the FROM / JOIN targets of a shared SQL text at the private views."""
    import re

    return re.sub(r"\b(FROM|JOIN)(\s+)([A-Za-z_][A-Za-z0-9_]*)",
                  lambda m: f"{m.group(1)}{m.group(2)}{private_view(m.group(3))}", sql)


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose tables as private temp views for SQL-defined derived views."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(private_view(n))
