"""Streams of many micro-batches: results, order inside a batch, and state that goes."""

import pandas as pd
from pyspark.sql import functions as F

from siftwork.plans import q_stream as Q
from siftwork.plans.registry import load_all
from siftwork.streaming import stream as ST

from .conftest import SF_SMALL

load_all()


def test_bounded_dedupe_removes_state(spark):
    out, progress = Q.run_dedupe_bounded(spark, SF_SMALL)
    assert sum(p["numInputRows"] > 0 for p in progress) >= 5
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert out.count() == events and ST.evicted(progress) > events / 2 and max(held) < events


def test_first_pairs_remove_state(spark):
    out, progress = Q.run_first_pairs(spark, SF_SMALL, keep="20 MINUTES")
    assert sum(p["numInputRows"] > 0 for p in progress) >= 5 and ST.evicted(progress) > 0
    assert out.select("pair_hash").distinct().count() <= out.count()


def stream_of(spark, tmp_path, batches, keep):
    source, rows = str(tmp_path / "src"), [(i, *r) for i, b in enumerate(batches) for r in b]
    df = spark.createDataFrame(rows, "slice int, k string, at int, pos int").select(
        "slice", "k", F.timestamp_seconds(F.col("at") * 60).alias("t"), "pos")
    ST.stage_files(df, source, key="slice", files=len(batches))
    s = ST.read_files(ST.stream_session(spark, 2), source, df.schema, files_per_trigger=1)
    progress = ST.append_to(ST.first_in_order(s, ["k"], ["t", "pos"], "t", keep, "0 seconds"), str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "sink")).toPandas()
    minutes = (got.t - pd.Timestamp("1970-01-01")).dt.total_seconds() // 60
    return sorted(zip(got.k.fillna("-"), minutes.astype(int), got.pos)), progress


def test_first_in_order_and_return_after_its_time(spark, tmp_path):
    batches = [[("a", 1, 5), ("a", 1, 2), ("b", 1, 9), (None, 1, 1)], [("a", 5, 1), ("c", 5, 1), (None, 4, 0)],
               [("b", 30, 3), ("d", 30, 1)], [("a", 31, 8), ("a", 31, 7)], [("e", 60, 1)], [("d", 61, 1)]]
    got, progress = stream_of(spark, tmp_path, batches, "10 minutes")
    # a and b come back after they were forgotten, d too; the earlier repeats of a and the null key are dropped
    assert got == sorted([("a", 1, 2), ("b", 1, 9), ("-", 1, 1), ("c", 5, 1), ("b", 30, 3), ("d", 30, 1), ("a", 31, 7),
                          ("e", 60, 1), ("d", 61, 1)])
    assert ST.evicted(progress) == 4


def test_files_arrive_in_order_of_their_key(spark, tmp_path):
    source = str(tmp_path / "src")
    ST.stage_files(spark.range(1000).selectExpr("id", "id DIV 100 AS part"), source, key="id", files=10)
    seen = []
    s = ST.read_files(ST.stream_session(spark, 2), source, spark.read.parquet(source).schema, files_per_trigger=1)

    def note(batch, _number):
        seen.append((batch.agg(F.min("id"), F.max("id")).first()))

    ST.finish(s.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert len(seen) == 10 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
