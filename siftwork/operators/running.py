"""Ordered running totals without a single-task window.

A window ordered over a whole table runs in one task.  Here the rows are dealt
by ranges of the order, so each task holds a stretch of it; one total per range
(as many rows as there are shuffle partitions, whatever the table holds) gives
the offsets, and a window inside each range does the rest.  The dealt rows are
written once: ranges come from a sample, and both uses must see the same ones.  The
sample reads the input a first time, so callers stage an input that is dear to compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def ranked(df: DataFrame, order: list[Column], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds each value and ``<value>_cum``, its sum over the rows up to this one."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.withColumns(values).repartitionByRange(n, *order)
                   .withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
               .select("_range", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}")
                                   for v in values]))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # at most one row per shuffle partition
    return dealt.join(F.broadcast(offsets), "_range").select(
        *df.columns, *[c for c in values if c not in df.columns],
        *[(F.col(f"_o_{v}") + F.sum(v).over(inside)).alias(f"{v}_cum") for v in values])


def running_sum(df: DataFrame, order_key: str, value_cols: list[str], suffix: str = "_cum") -> DataFrame:
    """Adds ``<col><suffix>`` = sum of ``col`` over rows with key <= this key.

    Keys may be sparse, but must be unique: rows of one key would be summed one
    after the other.
    """
    out = ranked(df, [F.col(order_key)], {c: F.col(c) for c in value_cols})
    return out.withColumnsRenamed({f"{c}_cum": f"{c}{suffix}" for c in value_cols})
