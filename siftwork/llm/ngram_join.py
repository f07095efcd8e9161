"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

The documents' sets of distinct 5-word shingles are the rows of a sparse matrix.
Two documents link when 100 * overlap >= 75 * union.  Steps, all exact:

1. Columns.  Map tasks send each shingle's key to a block of columns, many keys of a
   batch of documents packed in one row.  A shingle that several documents of a batch
   share goes out once, with their number, so a passage that a third of all
   documents hold costs one entry per batch.  A block finds which columns have two
   entries or more; columns with one cannot add to any overlap.
2. Rows.  Back at its batch, a document keeps its shared columns.  If they are
   less than 75% of its set, no document can link with it (the union is at least
   its own set), and it is out.  This leaves the copies, near copies and little else.
3. Equal sets are one row from here on (copies are never expanded).
4. Prefixes.  With columns ordered by number of entries (one; few; then the frequent by
   powers of two) and key, two rows that link share a column among the first
   n - ceil(0.75 n) + 1 of each.  Columns without a second entry come first, so the
   part of the prefix that can meet is short, and passages that very many documents
   hold are rarely in it.
5. Products.  For each prefix column the rows are multiplied with one row of the column
   only, the one with the smallest part that no other document has; overlaps are counted over the full rows, and pairs whose sizes
   or counts are below the bound are discarded.  Links merge rows to components.
   Columns whose rows are then all in one component are done.  The others get a
   second such turn with the largest id, and after it every pair of rows of different
   components, not yet counted, is multiplied if the bounds allow: at the first column
   that two rows share, what each has left from there on must reach 3/7 of both sizes
   together.  Pairs inside a component are never formed, as they can change none.

The key of a column has its block and 36 bits, more blocks as there is more data: two
different shingles of two documents share a key about once in 10**7 pairs of
documents, which moves an overlap by one.

Defined cases: fewer than five words are one shingle as a whole; a text without
words, null or empty has no set and links with nothing; its component is its own
id.  Rows with one doc_id are one document as far as components go, whatever their texts.  Rows without
doc_id get their set size and a null component, and take part in no link.  Other columns,
whatever their names, are ignored (``keep_representatives`` carries them); an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_at_exit, fresh_path, staged as stage
from .common import shuffle_width, text_bytes, whole_rows, worker_cache
from .components import components
from .words import mixed, word_hashes

WORDS = 5
PERCENT = 75
KEY_BITS = 36
#: Columns of a batch that the map side packs together, and text bytes per block.
BATCH, BLOCK_BYTES = 700_000, 10_000_000
#: Entries of a column from which it may count as frequent, and how many such columns are told to all tasks.
FREQUENT_FROM, FREQUENT_MOST = 32, 1 << 17
#: Marks, in an entry's place for the document, the number of documents of the batch that share it.
SHARED, MOST_DOCS = 0xC000, 0xC000

PACKET = "kind int, key long, batch long, payload binary"
ROWS = "kind int, doc_id long, n long, set_key binary, columns binary"


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of one document, sorted."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k:n - width + 1 + k]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))


def located(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of a hash, from its upper half, and its key there, from the lower bits."""
    return (((keys >> np.uint64(36)) * np.uint64(blocks)) >> np.uint64(28)).astype(np.int64), keys & np.uint64(
        (1 << KEY_BITS) - 1)


def packed(keys: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted keys with a 16-bit mark each: counts by the upper 12 bits, then 24 bits
    and the mark per entry."""
    counts = np.bincount((keys >> np.uint64(24)).astype(np.int64), minlength=4096).astype("<u4")
    low = (keys & np.uint64(0xFFFFFF)).astype("<u4")
    return (counts.tobytes() + low.astype("<u2").tobytes() + (low >> 16).astype("u1").tobytes()
            + marks.astype("<u2").tobytes())


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(payload, "<u4", 4096)
    n = int(counts.sum())
    low = np.frombuffer(payload, "<u2", n, 16384).astype(np.uint64)
    high = np.frombuffer(payload, "u1", n, 16384 + 2 * n).astype(np.uint64)
    marks = np.frombuffer(payload, "<u2", n, 16384 + 3 * n)
    top = np.repeat(np.arange(4096, dtype=np.uint64), counts)
    return (top << np.uint64(24)) | (high << np.uint64(16)) | low, marks


class Batch:
    """Documents whose columns are sent out together."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.set_keys: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.columns = 0

    def add(self, doc_id, found: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.set_keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
        self.sets.append(found)
        self.columns += len(found)

    def packets(self, batch: int, blocks: int) -> Iterator[tuple[int, int, int, bytes]]:
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        docs = np.repeat(np.arange(len(self.sets), dtype=np.int32), [len(s) for s in self.sets])
        block, key = located(flat, blocks)
        whole = (block.astype(np.uint64) << np.uint64(KEY_BITS)) | key
        order = np.argsort(whole)
        whole, docs = whole[order], docs[order]
        first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(whole)))
        shared = np.repeat(times > 1, times)
        yield 0, batch, batch, documents_payload(self, whole[shared], docs[shared])
        sent, marks = whole[first], np.where(times > 1, SHARED + np.minimum(times, 0xFFFF - SHARED), docs[first])
        limits = np.searchsorted(sent, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
        for b in range(blocks):
            part = slice(limits[b], limits[b + 1])
            if limits[b] < limits[b + 1]:
                yield 1, b, batch, packed(sent[part] & np.uint64((1 << KEY_BITS) - 1), marks[part])


def documents_payload(batch: Batch, shared: np.ndarray, docs: np.ndarray) -> bytes:
    n = len(batch.ids)
    known = np.array([i is not None for i in batch.ids], "u1")
    ids = np.array([i if i is not None else 0 for i in batch.ids], "<i8")
    return b"".join((np.array([n, len(shared)], "<i8").tobytes(), known.tobytes(), ids.tobytes(),
                     np.array(batch.sizes, "<i8").tobytes(), b"".join(batch.set_keys),
                     shared.astype("<u8").tobytes(), docs.astype("<u2").tobytes()))


def documents_of(payload: bytes):
    n, m = np.frombuffer(payload, "<i8", 2).tolist()
    at = 16
    known = np.frombuffer(payload, "u1", n, at)
    ids = np.frombuffer(payload, "<i8", n, at + n)
    sizes = np.frombuffer(payload, "<i8", n, at + 9 * n)
    set_keys = payload[at + 17 * n:at + 33 * n]
    shared = np.frombuffer(payload, "<u8", m, at + 33 * n)
    docs = np.frombuffer(payload, "<u2", m, at + 33 * n + 8 * m)
    return known, ids, sizes, set_keys, shared, docs


def incidence(docs: DataFrame, doc_id: str, text: str, blocks: int, size: int) -> DataFrame:
    """Step 1, map side: packed columns for each block, and the documents of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("join")
        base, made, held = TaskContext.get().partitionId() << 24, 0, Batch()

        def out(rows):
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                    row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "key", "batch", "payload"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, found, counts in word_hashes(batch.column("text")):
                for i in range(first, end):
                    held.add(ids[i], shingles(found[counts[i - first]:counts[i - first + 1]], size))
                    if held.columns >= BATCH or len(held.ids) >= MOST_DOCS:
                        yield from out(held.packets(base + made, blocks))
                        made, held = made + 1, Batch()
        if held.ids:
            yield from out(held.packets(base + made, blocks))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKET)


def shared_columns(key, table):
    """Step 1, block side: entries of columns that have another one, back to their batches."""
    worker_cache("join")
    rows: dict[str, list] = {"kind": [], "key": [], "batch": [], "payload": []}

    def emit(kind, key, batch, payload):
        for name, value in (("kind", kind), ("key", key), ("batch", batch), ("payload", payload)):
            rows[name].append(value)

    batches, parts = [], []
    for kind, k, batch, payload in zip(*(table.column(c) for c in ("kind", "key", "batch", "payload"))):
        if kind.as_py() == 0:
            emit(0, batch.as_py(), batch.as_py(), payload.as_py())
        else:
            batches.append(batch.as_py())
            parts.append(unpacked(payload.as_py()))
    if parts:
        block = np.uint64(key[1].as_py()) << np.uint64(KEY_BITS)
        keys = np.concatenate([k for k, _ in parts])
        marks = np.concatenate([m for _, m in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        del parts
        order = np.argsort(keys)
        keys, marks, owner = keys[order], marks[order], owner[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        weight = np.where(marks >= SHARED, marks.astype(np.int64) - SHARED, 1)
        total = np.add.reduceat(weight, first)
        times = np.diff(np.append(first, len(keys)))
        often = total >= FREQUENT_FROM
        if often.any():
            emit(2, -1 - int(key[1].as_py()), -1, (keys[first[often]] | block).astype("<u8").tobytes()
                 + total[often].astype("<i8").tobytes())
        back = np.repeat(total > 1, times) & (marks < SHARED)
        keys, marks, owner = keys[back], marks[back], owner[back]
        order = np.argsort(owner, kind="stable")
        keys, marks, owner = keys[order], marks[order], owner[order]
        limits = np.searchsorted(owner, np.arange(len(batches) + 1))
        for b, batch in enumerate(batches):
            part = slice(limits[b], limits[b + 1])
            if limits[b] < limits[b + 1]:
                emit(1, batch, batch, (keys[part] | block).astype("<u8").tobytes() + marks[part].tobytes())
    return pa.table({"kind": pa.array(rows["kind"], pa.int32()), "key": pa.array(rows["key"], pa.int64()),
                     "batch": pa.array(rows["batch"], pa.int64()), "payload": pa.array(rows["payload"], pa.binary())})


def shared_rows(percent: int):
    """Step 2: documents of a batch with their shared columns, where those suffice for a link."""
    def run(key, table):
        kinds = table.column("kind").to_pylist()
        payloads = table.column("payload")
        out: dict[str, list] = {"kind": [], "doc_id": [], "n": [], "set_key": [], "columns": []}
        columns, docs, document = [], [], None
        for i, kind in enumerate(kinds):
            payload = payloads[i].as_py()
            if kind == 2:
                for name, value in (("kind", 2), ("doc_id", None), ("n", len(payload) // 16), ("set_key", None),
                                    ("columns", payload)):
                    out[name].append(value)
            elif kind == 0:
                document = documents_of(payload)
                columns.append(document[4])
                docs.append(document[5])
            else:
                n = len(payload) // 10
                columns.append(np.frombuffer(payload, "<u8", n))
                docs.append(np.frombuffer(payload, "<u2", n, 8 * n))
        if document is not None:
            known, ids, sizes, set_keys = document[:4]
            flat, owner = np.concatenate(columns), np.concatenate(docs)
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
            limits = np.searchsorted(owner, np.arange(len(ids) + 1))
            for d in range(len(ids)):
                found, n = flat[limits[d]:limits[d + 1]], int(sizes[d])
                live = n and known[d] and 100 * len(found) >= percent * n
                for name, value in (("kind", 0), ("doc_id", int(ids[d]) if known[d] else None), ("n", n),
                                    ("set_key", set_keys[16 * d:16 * d + 16]),
                                    ("columns", np.sort(found).astype("<u8").tobytes() if live else None)):
                    out[name].append(value)
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "doc_id": pa.array(out["doc_id"], pa.int64()),
                         "n": pa.array(out["n"], pa.int64()), "set_key": pa.array(out["set_key"], pa.binary()),
                         "columns": pa.array(out["columns"], pa.binary())})

    return run


def frequent_columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT_MOST columns, those with the most entries, and the power of two of each."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("columns").to_pylist():
                n = len(payload) // 16
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(payload, "<i8", n)),
                    pa.array(np.log2(np.frombuffer(payload, "<i8", n, 8 * n)).astype(np.int32))], ["key", "size"])

    found = stage(rows.filter("kind = 2").select("columns").mapInArrow(spread, "key long, size int"), "join-frequent")
    by_size = sorted(((r["size"], r["count"]) for r in found.groupBy("size").count().collect()), reverse=True)
    least, held = None, 0
    for size, count in by_size:
        if held + count > FREQUENT_MOST:
            break
        least, held = size, held + count
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    told = found.filter(F.col("size") >= least).collect()
    keys = np.array([r["key"] for r in told], np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["size"] for r in told], np.int32)[order]


def prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """Step 4: key, doc_id, n for the prefix columns that other documents have; ``rest``
    is the number of such columns from this one on, ``own`` the part of the set, in
    thousandths, that no other document has."""
    told = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, sizes_of = told.value
        for batch in batches:
            keys, ids, sizes, rests, owns = [], [], [], [], []
            for doc_id, n, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "columns"))):
                columns = np.frombuffer(payload, "<u8")
                length = n + (-percent * n // 100) + 1 - (n - len(columns))
                owns.append(1000 * (n - len(columns)) // n)
                if len(often):
                    at = np.minimum(np.searchsorted(often, columns), len(often) - 1)
                    late = np.where(often[at] == columns, sizes_of[at], 0)
                    columns = columns[np.lexsort((columns, late))]
                keys.append(columns[:length].astype(np.int64))
                rests.append(len(columns) - np.arange(len(keys[-1])))
                ids.append(doc_id)
                sizes.append(n)
            lengths = [len(k) for k in keys]
            if keys:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(ids, np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int64), lengths)), pa.array(np.concatenate(rests)),
                    pa.array(np.repeat(np.array(owns, np.int64), lengths))], ["key", "doc_id", "n", "rest", "own"])

    return rows.select("doc_id", "n", "columns").mapInArrow(run, "key long, doc_id long, n long, rest long, own long")


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 5: pairs a, b that link, with their overlap counted over whole rows."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("columns").alias("columns_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("columns").alias("columns_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").filter(
        percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, overlap = [], [], []
            first, second = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            n = list(zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()))
            rows, others = batch.column("columns_a"), batch.column("columns_b")
            for i in range(batch.num_rows):
                merged = np.concatenate((np.frombuffer(rows[i].as_buffer(), "<u8"),
                                         np.frombuffer(others[i].as_buffer(), "<u8")))
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                if 100 * common >= percent * (sum(n[i]) - common):
                    a.append(first[i])
                    b.append(second[i])
                    overlap.append(common)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                              pa.array(overlap, pa.int64())], ["a", "b", "overlap"])

    return both.mapInArrow(run, "a long, b long, overlap long")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def least_own() -> Column:
    """The row of a column with the smallest part that no other has, which is the original rather
    than one of its near copies, as each of these has changes of its own."""
    return F.min(F.struct("own", "doc_id"))["doc_id"]


def last() -> Column:
    return F.max("doc_id")


def star_pairs(placed: DataFrame, centre) -> DataFrame:
    """Rows of a column with one of them, the centre, across components."""
    centres = placed.groupBy("key").agg(centre().alias("centre"), F.min("component").alias("low"),
                                        F.max("component").alias("high")).filter("low < high")
    joined = placed.join(stage(centres.select("key", "centre"), "join-centres"), "key").filter("doc_id != centre")
    return joined.select(*ordered("doc_id", "centre")).distinct()


def cross_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of a column that are in different components and can link by the
    bounds.  The rows of a column's largest component meet the others only; the
    others meet among themselves."""
    held = stage(placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n_rows")), "join-held")
    largest = stage(held.groupBy("key").agg(F.max(F.struct("n_rows", "component")).alias("l")).select(
        "key", F.col("l.component").alias("largest")), "join-largest")
    told = stage(placed.join(largest, "key"), "join-told")
    main = told.filter("component = largest")
    others = told.filter("component != largest")

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(F.col("key").alias(f"key{mark}"), *[F.col(c).alias(f"{c}{mark}") for c in (
            "component", "doc_id", "n", "rest")])

    def meet(x: DataFrame, y: DataFrame, different) -> DataFrame:
        bound = (100 + percent) * F.least("rest1", "rest2") >= percent * (F.col("n1") + F.col("n2"))
        return x.join(y, (F.col("key1") == F.col("key2")) & different & bound).select(*ordered("doc_id1", "doc_id2"))

    apart = F.col("component1") < F.col("component2")
    return meet(side(main, 1), side(others, 2), F.lit(True)).unionByName(
        meet(side(others, 1), side(others, 2), apart)).distinct()


def unsettled(prefix: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows with their components, of columns that hold two components or more."""
    placed = prefix.withColumn("component", F.col("doc_id")) if labels is None else (
        prefix.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id")))
    placed = stage(placed, "join-placed")
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(
        "low < high")
    return stage(placed.join(stage(mixed_keys.select("key"), "join-mixed"), "key", "left_semi"), "join-unsettled")


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS,
                  percent: int = PERCENT, blocks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): doc_id, n, set_key per row of ``docs``; set_key, its number
    node and rep, the smallest doc_id with that set; and id, component for every node that
    links.  Nodes are sets, so an id that stands for several texts has a node for each."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    blocks = blocks or max(width, -(-text_bytes(docs, text) // BLOCK_BYTES))
    sent = incidence(docs, doc_id, text, blocks, size)
    # documents of a batch travel with the columns, to whatever block their number falls in
    back = sent.groupBy("kind", "key").applyInArrow(shared_columns, PACKET)
    rows = stage(back.groupBy("key").applyInArrow(shared_rows(percent), ROWS), "join-rows")
    members = rows.filter("kind = 0").select("doc_id", "n", "set_key")
    classes = numbered_sets(stage(members.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep")), "join-classes"))
    live = rows.filter("kind = 0 AND columns IS NOT NULL").select("doc_id", "n", "set_key", "columns").join(
        classes, "set_key").filter("doc_id = rep").select(F.col("node").alias("doc_id"), "n", "columns")
    # sets are bucketed by id, so that counting overlaps never moves them again; their files
    # lie in the shared folder and go with it
    name, path = f"join_sets_{uuid.uuid4().hex}", fresh_path(spark, "join-sets")
    (live.dropDuplicates(["doc_id"]).write.bucketBy(width, "doc_id").format("parquet")
     .option("path", path).saveAsTable(name))
    delete_at_exit(spark, path)
    try:
        links, labels = linked_sets(rows, spark.table(name), percent)
    finally:
        spark.sql(f"DROP TABLE {name}")
    return members, classes, labels


def numbered_sets(classes: DataFrame) -> DataFrame:
    """``classes`` with node: rep; further sets of one rep get numbers below all of these."""
    several = stage(classes.groupBy("rep").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last"))
                    .filter("first < last").select(F.col("rep").alias("of"), "first"), "join-several-sets")
    if several.isEmpty():
        return classes.withColumn("node", F.col("rep"))
    least = classes.agg(F.min("rep")).first()[0]
    further = classes.join(several, F.col("rep") == F.col("of"), "left").withColumn(
        "node", F.when(F.col("set_key") > F.col("first"), F.lit(least - 1) - F.monotonically_increasing_id())
        .otherwise(F.col("rep")))
    return stage(further.select("set_key", "rep", "node"), "join-classes")


def linked_sets(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links a, b between sets, and the component of every set that has one."""
    prefix = stage(prefixes(sets, frequent_columns(rows), percent), "join-prefix")
    links, labels, tested = None, None, None
    for turn in (least_own, last, None):
        placed = unsettled(prefix, labels)
        if labels is not None and placed.isEmpty():
            break
        pairs = star_pairs(placed, turn) if turn else cross_pairs(placed, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "join-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stage(overlaps(pairs, sets, percent), "join-links")
        if labels is not None and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = components(links.select("a", "b"))
    return links, labels


def united(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels``, with the components of the sets of one doc_id made one."""
    several = stage(members.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low < high").select("doc_id"), "join-several")
    if several.isEmpty():
        return labels
    nodes = stage(members.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(
        classes, "set_key").select("doc_id", "node"), "join-nodes")
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("b"))
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(
        nodes.join(first, "doc_id").select(F.col("node").alias("a"), "b")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    members, classes, labels = jaccard_links(docs, doc_id, text, **params)
    labels = united(members, classes, labels)
    told = stage(classes.join(labels, classes["node"] == labels["id"], "left").select(
        "set_key", "rep", F.coalesce("component", "node").alias("group")), "join-groups")
    least = told.groupBy("group").agg(F.min("rep").alias("component"))
    placed = stage(told.join(least, "group").select("set_key", "component"), "join-components")
    linked = members.join(placed, "set_key", "left")
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("component")).alias("component_id"))


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the row with the
    smallest doc_id; rows without words, without links or without id stay.  Where ids are
    repeated every row is a document of its own here, so no text goes for another's link."""
    rows = whole_rows(docs, id=F.col(doc_id))
    if docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1").isEmpty():
        gone = stage(near_duplicates(docs, doc_id, text, **params).filter("component_id != doc_id")
                     .select(F.col("doc_id").alias("gone")), "join-gone")
        return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
    numbered = stage(rows.withColumn("number", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())), "join-numbered")
    found = near_duplicates(numbered.select("number", F.col("row")[text].alias("text")), "number", "text", **params)
    placed = stage(found.filter("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("number"), "component_id")
                   .join(numbered.select("number", "id"), "number"), "join-placed-rows")
    first = placed.groupBy("component_id").agg(F.min(F.struct("id", "number"))["number"].alias("first"))
    gone = stage(placed.join(first, "component_id").filter("number != first").select(F.col("number").alias("gone")), "join-gone")
    return numbered.join(gone, F.col("number") == F.col("gone"), "left_anti").select("row.*")
