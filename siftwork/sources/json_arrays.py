"""JSON arrays of any size, read in parallel (S-1, V-2).

The layout is one JSON array per file, on one line or pretty-printed.  JSON has no
record separator, so where an entry ends depends on all that comes before it: whether
the place is inside a string, and how deep.  Three steps find it without reading a file
in one piece:

1. Spark's text source, told that a line ends at ``}``, deals a file to tasks by byte
   ranges like any other text.  A task packs its lines into pieces and sums each up under
   both assumptions, that it starts inside a string or outside: the parity of its quotes, how
   much deeper it ends, and how many separators it has at each depth.
2. A window over these sums (one short row per piece) gives every piece its true start:
   inside or outside, depth, number of entries before it.
3. Pieces are cut at the separators of depth one.  Entries inside one piece are done;
   the parts of those that cross pieces are joined by entry number.

``}`` is never part of an escape, so no piece starts in the middle of one.  Step 2 orders
the sums of one file in one task: a row of some 100 bytes per ``PIECE`` bytes of text.  The
join that brings them back to the pieces broadcasts them while they are few.

A file is rejected if it does not begin with ``[`` ("not an array"), or if it is no JSON
array: broken off, text after it, an empty or malformed entry ("not JSON").  An empty
file is not JSON; ``[]`` is an array without entries.  Compressed files are read
by one task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged

#: Bytes of text in one piece.
PIECE = 4 << 20
QUOTE, COMMA, SLASH = ord('"'), ord(","), ord("\\")
OPEN_LIST, CLOSE_LIST, OPEN_OBJECT, CLOSE_OBJECT = b"[]{}"
STEP = np.zeros(256, np.int64)
STEP[[OPEN_LIST, OPEN_OBJECT]], STEP[[CLOSE_LIST, CLOSE_OBJECT]] = 1, -1
#: Entry numbers of what is no entry: text before the array or after it, and its end.
BEFORE, AFTER, END = -1, -2, -3


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the quotes that begin or end a string, and of brackets and commas."""
    quotes = np.flatnonzero(data == QUOTE)
    slashes = data == SLASH
    if slashes.any():
        other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        before = np.append(-1, other)[quotes]  # last place before the quote that is no backslash
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    places = np.flatnonzero((STEP[data] != 0) | (data == COMMA))
    return quotes, places


def outside(quotes: np.ndarray, places: np.ndarray, inside: int) -> np.ndarray:
    """The places outside strings, if the text starts inside one (1) or not (0)."""
    return places[(np.searchsorted(quotes, places) + inside) % 2 == 0]


def summary(body: bytes) -> tuple[int, list[int], list[list[tuple[int, int]]]]:
    """Parity of the quotes; per assumption the change of depth, and how many commas and
    opened lists leave which depth (counted from the start)."""
    data = np.frombuffer(body, np.uint8)
    quotes, places = marks(data)
    change, separators = [], []
    for inside in (0, 1):
        at = outside(quotes, places, inside)
        depth = np.cumsum(STEP[data[at]])
        change.append(int(depth[-1]) if len(depth) else 0)
        found = np.unique(depth[(data[at] == COMMA) | (data[at] == OPEN_LIST)], return_counts=True)
        separators.append(list(zip(*(x.tolist() for x in found))))
    return len(quotes) % 2, change, separators


def segments(body: bytes, inside: int, depth: int, before: int) -> list[tuple[int, bytes, bool]]:
    """Entry number, text and whether that is the whole entry, of all between two
    separators; ``before`` entries have begun earlier."""
    data = np.frombuffer(body, np.uint8)
    at = outside(*marks(data), inside)
    kind = data[at]
    deep = depth + np.cumsum(STEP[kind])
    cuts = ((deep == 1) & ((kind == COMMA) | (kind == OPEN_LIST))) | ((deep == 0) & (STEP[kind] < 0))
    out, start, begun = [], 0, False
    entry = before - 1 if depth > 0 else AFTER if before else BEFORE
    for place, what in zip(at[cuts].tolist(), kind[cuts].tolist()):
        out.append((entry, body[start:place], begun))
        if what == COMMA or (what == OPEN_LIST and entry == BEFORE):
            entry = before
            before += 1
        else:
            out.append((END if what == CLOSE_LIST else AFTER, b"]" if what == CLOSE_LIST else b"?", True))
            entry = AFTER
        start, begun = place + 1, True
    return [s for s in [*out, (entry, body[start:], False)] if s[0] >= 0 or s[1].strip(b" \t\r\n")]


def pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """file, block, seq, body and its sums, in the order of the file."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"),
        F.col("value").cast("binary").alias("line"))
    names = ["file", "block", "seq", "body", "parity", "change", "separators"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        many, seq, place = 0, 0, None

        def piece() -> pa.RecordBatch:
            body = b"}".join([*held, b""])
            parity, change, separators = summary(body)
            return pa.RecordBatch.from_arrays([
                pa.array([place[0]], pa.string()), pa.array([place[1]], pa.int64()), pa.array([seq], pa.int32()), pa.array([body], pa.binary()),
                pa.array([parity], pa.int32()), pa.array([change], pa.list_(pa.int32())),
                pa.array([separators], pa.list_(pa.map_(pa.int32(), pa.int64())))], names)

        for batch in batches:
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if place != (file, block) or many > size:
                    if held:
                        yield piece()
                    seq = seq + 1 if place == (file, block) else 0
                    held, many, place = [], 0, (file, block)
                held.append(line)
                many += len(line) + 1
        if held:
            yield piece()

    return lines.mapInArrow(run, "file string, block long, seq int, body binary, parity int, change array<int>, "
                                 "separators array<map<int,bigint>>")


def starts(sums: DataFrame) -> DataFrame:
    """file, block, seq of each piece with inside, depth, before (entries) and last."""
    order = Window.partitionBy("file").orderBy("block", "seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    told = sums.withColumn("inside", (total(F.col("parity")) % 2).cast("int"))
    told = told.withColumn("depth", total(F.get("change", F.col("inside"))).cast("int"))
    own = F.coalesce(F.try_element_at(F.get("separators", F.col("inside")), 1 - F.col("depth")), F.lit(0))
    return told.withColumn("own", own).select(
        "file", "block", "seq", "inside", "depth", total(F.col("own")).alias("before"),
        F.lead("seq").over(order).isNull().alias("last"))


def scan_json_arrays(spark: SparkSession, path: str, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(entries, files): ``entries`` has file, entry_idx (from 0) and the entry's JSON text,
    of every file that is an array; ``files`` has file, entries and reason (null: accepted)."""
    cut = staged(pieces(spark, path, piece), "json-pieces")
    placed = cut.select("file", "block", "seq", "body").join(
        starts(cut.select("file", "block", "seq", "parity", "change", "separators")), ["file", "block", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                # a line's end was put back after every line; the last one has none in a JSON array
                body = row["body"][:-1] if row["last"] else row["body"]
                found = segments(body, row["inside"], row["depth"], row["before"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["file"]] * len(found), pa.string()), pa.array([row["block"]] * len(found), pa.int64()),
                    pa.array([row["seq"]] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.bool_())],
                    ["file", "block", "seq", "entry_idx", "text", "whole"])

    found = staged(placed.mapInArrow(run, "file string, block long, seq int, entry_idx long, text binary, whole boolean")
                   .withColumn("text", F.col("text").cast("string")), "json-segments")
    of_entries = found.where("entry_idx >= 0")
    joined = of_entries.where("NOT whole").groupBy("file", "entry_idx").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("block", "seq", "text"))), lambda p: p["text"]), "").alias("entry"))
    entries = staged(of_entries.where("whole").select("file", "entry_idx", F.col("text").alias("entry")).unionByName(joined)
                     .withColumn("blank", F.trim(F.translate("entry", "\t\r\n", "   ")) == "")
                     .withColumn("parsed", F.try_parse_json("entry").isNotNull()), "json-entries")
    per_entry = entries.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("n_blank"), F.count_if(~F.col("parsed")).alias("n_bad"))
    per_file = found.groupBy("file").agg(
        F.max(F.col("entry_idx") == BEFORE).alias("other"), F.max(F.col("entry_idx") == AFTER).alias("more"),
        F.count_if(F.col("entry_idx") == END).alias("ends"))
    told = listed_files(spark, path).join(per_file, "file", "left").join(per_entry, "file", "left").fillna(
        False, ["other", "more"]).fillna(0, ["ends", "n", "n_blank", "n_bad"])
    no_entries = (F.col("n") == 1) & (F.col("n_blank") == 1)
    files = staged(told.select(
        "file", F.when(no_entries, F.lit(0)).otherwise(F.col("n")).cast("long").alias("entries"),
        F.when(F.col("other"), "not an array").when(
            F.col("more") | (F.col("ends") != 1) | (~no_entries & (F.col("n_bad") > 0)), "not JSON").alias("reason")), "json-files")
    good = files.where("reason IS NULL").select("file")
    return entries.where(~F.col("blank")).select("file", "entry_idx", "entry").join(good, "file", "left_semi"), files


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of all files, also of those without a line (from the listing that each read makes)."""
    return spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")


def read_json_arrays(spark: SparkSession, path: str, schema: StructType, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """S-1: (entries, rejects).  Entries have file, entry_idx and the columns of ``schema``, of the files that
    are arrays of objects; rejects have file and reason."""
    entries, files = scan_json_arrays(spark, path, piece)
    is_object = F.schema_of_variant(F.try_parse_json("entry")).startswith("OBJECT")
    odd = staged(entries.where(~F.coalesce(is_object, F.lit(False))).select("file").distinct(), "json-odd")
    rejects = files.where("reason IS NOT NULL").select("file", "reason").unionByName(
        odd.withColumn("reason", F.lit("an entry is not an object")))
    typed = entries.join(odd, "file", "left_anti").select("file", "entry_idx", F.from_json("entry", schema).alias("e"))
    return typed.select("file", "entry_idx", "e.*"), rejects
