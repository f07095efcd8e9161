"""Structured Streaming forms of the incremental behaviour (ST-1..ST-4).

* ST-1 first sighting of a key across micro-batches: ``dropDuplicates`` keeps
  every key seen in the state store (there is no event time in the data, so
  the state is unbounded); with a caller-supplied event-time column the
  bounded form is ``withWatermark`` + ``dropDuplicatesWithinWatermark``.
  Where several rows of a key meet in one micro-batch and the first in a given order
  must win, ``first_in_order`` is a stateful operator with a time to live.
* ST-2 append accepted records as they arrive: file sink in append mode with a
  checkpoint, so a restarted query neither loses nor repeats records.
* ST-3 running progress: an update-mode aggregate; foreachBatch writes changed keys only.
* ST-4 the stateless page pipeline applied to a stream.

All runs use ``trigger(availableNow=True)``: process what is there, stop.
Checkpoints and sinks live under the shared checkpoint folder.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from ..session import scratch_path


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of the same application for one streaming query.

    A streaming query fixes its shuffle width, and with it the number of state
    stores, at its first start.  The width is a parameter (default: as many as
    there are cores) and is set on a session of the query's own, so no other
    query of the caller ever sees it.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    return own


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run (sources, sink, checkpoint)."""
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def stage_files(df: DataFrame, path: str, key: str | None = None, files: int | None = None) -> None:
    """Write a batch table as a file-stream source: as many files as it has
    partitions, or ``files`` in ranges of ``key`` if the order of arrival matters."""
    if key is None:
        df.write.mode("overwrite").parquet(path)
        return
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).write.mode("overwrite").parquet(path)
    in_order(df.sparkSession, path)


def in_order(spark: SparkSession, path: str) -> None:
    """Date the files of one write by their numbers: a file stream takes them by date, and
    tasks finish in any order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    last = fs.getFileStatus(folder).getModificationTime()
    for i, p in enumerate(found):
        fs.setTimes(p, last - 1000 * (len(found) - i), -1)


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """File-stream source with an explicit schema (no inference on a stream);
    by default as many files per trigger as there are cores to read them."""
    n = files_per_trigger or max(2, spark.sparkContext.defaultParallelism)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(path)


def first_sightings(stream: DataFrame, keys: list[str], event_time: str | None = None,
                    delay: str = "1 hour") -> DataFrame:
    """ST-1: keep the first row per key across micro-batches."""
    if event_time is not None:
        if isinstance(stream.schema[event_time].dataType, TimestampNTZType):
            # watermarks need TIMESTAMP; a zone-less time is read in the session time zone
            stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def first_in_order(stream: DataFrame, keys: list[str], order: list[str], event_time: str, keep: str,
                   late: str | None = None) -> DataFrame:
    """ST-1 as a stateful operator: of each key the first row in ``order`` of the
    micro-batch that first has it; later ones are dropped while the key is remembered.

    A key is remembered for ``keep`` (such as "2 hours") of event time after that row.  Once the
    watermark is past it the state is removed, so the state holds the keys of that stretch and
    not of the whole stream; a row of a later time is a first sighting again, one per key and
    micro-batch, whether or not the state is gone yet.  Rows of a hot key come in chunks of which
    only the first in order so far is held; null keys are a key of their own.  Rows more than
    ``late`` (default: as long as ``keep``) behind the newest are dropped by the watermark.
    """
    schema = stream.schema
    millis = stream.sparkSession.range(1).select(F.expr(f"CAST(1000 * unix_seconds(TIMESTAMP '1970-01-01 00:00:00+00' + INTERVAL {keep}) "
                                                        "AS BIGINT)")).first()[0]

    def first(_key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = pd.Timestamp(state.get[0], unit="ms") if state.exists else None
        best = None
        for chunk in chunks:
            rows = chunk if known is None else chunk[chunk[event_time] >= known]
            if len(rows):
                rows = rows if best is None else pd.concat([best, rows], ignore_index=True)
                best = rows.sort_values(order, kind="stable").head(1)
        if best is None:
            return
        end = int(best[event_time].iloc[0].timestamp() * 1000) + millis
        if end > state.getCurrentWatermarkMs():
            state.update((end,))
            state.setTimeoutTimestamp(end)
        yield best

    dated = stream.withWatermark(event_time, late or keep)
    return dated.groupBy(*keys).applyInPandasWithState(first, schema, "until long", "append", "EventTimeTimeout")


def finish(query) -> list[dict]:
    """Wait for the end; what the query says of its micro-batches."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return [json.loads(p.json) for p in query.recentProgress]


def evicted(progress: list[dict]) -> int:
    """Keys whose state the micro-batches removed."""
    return sum(o["numRowsRemoved"] for p in progress for o in p["stateOperators"])


def append_to(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> list[dict]:
    """ST-2: append mode file sink, run until the available input is consumed."""
    return finish(stream.writeStream.format(fmt).outputMode("append").option("path", sink)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def changes_to(agg: DataFrame, sink: str, checkpoint: str) -> None:
    """ST-3: each micro-batch writes the keys that it changed, under its own number;
    a repeated micro-batch replaces its own files."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/number={number}")

    finish(agg.writeStream.outputMode("update").foreachBatch(write)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest(spark: SparkSession, sink: str, key: str, value: str, key_type: str = "string") -> DataFrame:
    """The state after the last micro-batch: each key's last written value."""
    rows = spark.read.schema(f"{key} {key_type}, {value} long, number long").parquet(sink)
    return rows.groupBy(key).agg(F.max_by(value, "number").alias(value))


def key_counts(stream: DataFrame, key: str) -> DataFrame:
    """Per-key row counts (the state behind running totals and uniques)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
