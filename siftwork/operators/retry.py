"""Which attempt of each batch a sequential generator keeps (W-5), without the sequence.

Batches run in order.  A batch keeps its first attempt with a key that neither stored
data nor an earlier batch has; all keys of the kept attempt are then taken.  So an
attempt depends on what earlier batches keep, and those on still earlier ones.

Rounds settle whatever can be told, all batches at once.  A key of an undecided batch is
*taken* if a settled earlier batch keeps it, and *free* if no earlier batch, settled or
not, has it in any attempt that may still be kept.  An attempt whose keys are all taken
is out; a batch whose first remaining attempt has a free key is settled.  The first
undecided batch always gets on, keys that one batch has alone settle it at once, and a
round moves only rows of undecided batches.

Long chains (each batch waiting for the one before) would take a round per link, so once
no more than ``LAST`` rows are open one task walks through them in order.  That changes
the number of rounds, never the result.  Hot keys and hot batches are aggregated
before they are shuffled, and joined to one row per key or batch, which skew handling
splits.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Open rows (three numbers or hashes each) that one task may finish.
LAST = 100_000


def _walk(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """batch, attempt of the open batches, decided one after the other in one task."""
    schema = rows.select("batch", "attempt").schema
    known = taken.select(F.col("owner").alias("batch"), F.lit(None).cast(rows.schema["attempt"].dataType).alias("attempt"), "key")

    def walk(table: pa.Table) -> pa.Table:
        batches: dict = {}
        owner: dict = {}
        named: dict = {}
        for value, a, k in zip(*(table.column(c).to_pylist() for c in ("batch", "attempt", "key"))):
            b = tuple(value.values()) if isinstance(value, dict) else value
            named[b] = value
            if a is None:
                owner[k] = b
            else:
                batches.setdefault(b, {}).setdefault(a, []).append(k)
        out = []
        for b in sorted(batches):
            for a in sorted(batches[b]):
                keys = batches[b][a]
                if any(k not in owner or owner[k] > b for k in keys):
                    for k in keys:
                        owner[k] = min(owner.get(k, b), b)
                    out.append((named[b], a))
                    break
        return pa.table([pa.array([x[i] for x in out], table.schema.field(c).type)
                         for i, c in enumerate(("batch", "attempt"))], names=["batch", "attempt"])

    every = rows.select("batch", "attempt", "key").unionByName(known)
    return every.groupBy(F.lit(0).alias("all")).applyInArrow(walk, schema)


def kept_attempts(rows: DataFrame, batch: str = "batch_id", attempt: str = "attempt", key: str = "pair_hash",
                  last: int = LAST) -> DataFrame:
    """``batch``, ``attempt`` of every batch that keeps one.  ``rows`` holds the keys of
    each attempt that stored data does not have; null keys and batches count for nothing."""
    open_rows = staged(rows.select(F.col(batch).alias("batch"), F.col(attempt).alias("attempt"), F.col(key).alias("key"))
                       .dropna().distinct(), "retry-rows")
    taken = staged(open_rows.select("key", F.col("batch").alias("owner")).limit(0), "retry-taken")
    kept = []
    while True:
        many = open_rows.count()
        if not many or many <= last:
            kept.append(_walk(open_rows, taken))
            break
        first = open_rows.groupBy("key").agg(F.min("batch").alias("first"))
        told = open_rows.join(first, "key").join(taken, "key", "left")
        gone = F.coalesce(F.col("owner") < F.col("batch"), F.lit(False))
        each = told.groupBy("batch", "attempt").agg(
            F.max(~gone & (F.col("first") == F.col("batch"))).alias("free"), F.min(gone).alias("out"))
        picks = staged(each.where(~F.col("out")).groupBy("batch").agg(F.min(F.struct("attempt", "free")).alias("pick"))
                       .select("batch", F.col("pick.attempt").alias("from"), F.col("pick.free").alias("free")), "retry-picks")
        done = picks.where("free").select("batch", F.col("from").alias("attempt"))
        kept.append(done)
        now = open_rows.join(done, ["batch", "attempt"], "left_semi").select("key", F.col("batch").alias("owner"))
        open_rows = staged(open_rows.join(picks.where(~F.col("free")), "batch").where(F.col("attempt") >= F.col("from"))
                           .select("batch", "attempt", "key"), "retry-rows")
        taken = staged(taken.unionByName(now).join(open_rows.select("key").distinct(), "key", "left_semi")
                       .groupBy("key").agg(F.min("owner").alias("owner")), "retry-taken")
    return staged(reduce(DataFrame.unionByName, kept), "retry-kept").select(
        F.col("batch").alias(batch), F.col("attempt").alias(attempt))
