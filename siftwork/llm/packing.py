"""Best-fit packing by hierarchical residual packing.

Documents become token ids of the vocabulary's tokenizer and an end id; those longer than a sequence are cut
into full pieces with the shorter remainder first.  Full pieces are sequences at
once.  The rest is packed by best fit, longest first, inside each task; nearly full
bins are emitted, and underfull bins, now items of their filled length, go to the
next round, where a quarter as many tasks (at most one per ``PER_TASK`` bins)
repeat best fit.  Rounds end with one task, or when a round no longer saves a
fiftieth of the bins: then the rest is emitted as it is, so no task ever holds
more than about ``PER_TASK`` bins however many there are.

Defined cases: a null or empty text is its end id alone; repeated rows, repeated ids and rows
without an id are documents of their own; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from ..session import staged as stage
from .common import worker_cache
from .tokens import Merges, byte_symbols, vocabulary_path

CAPACITY, END_ID = 1024, 2
#: A bin with at most this much room is nearly full.
ROOM = 2
PER_TASK = 50_000


class Encoder:
    """text -> little-endian 32-bit ids of the vocabulary's tokenizer.

    The tokenizer applies listed merges, tiktoken joins any two neighbours whose bytes are
    a token, lowest id first, several times faster and without a store of earlier texts.
    ``by_bytes`` proves for a vocabulary that both give the same ids; for any other, and for
    texts that tiktoken refuses (a run of a million spaces), the tokenizer itself is asked.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        merges = Merges(path)
        tokens = token_bytes(path)
        self.fast = None
        if by_bytes(merges, tokens):
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens,
                                          special_tokens=merges.special).encode_to_numpy

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(self.ids, texts))

    def ids(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_bytes(path: str) -> dict[bytes, int]:
    """The bytes and the id of every token but the added ones."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    byte_of = {c: b for b, c in byte_symbols().items()}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}


def by_bytes(merges: Merges, tokens: dict[bytes, int]) -> bool:
    """Whether joining neighbours by their bytes, lowest id first, is the same as the listed merges.

    It is if ids follow the order of the merges, each token has one merge, of tokens made before
    it, and each token's own bytes are merged to it.  For then merges are done in rising
    order; when all lower ones are done inside the bytes of a token, what is left there are
    the two tokens of its own merge, so no other two neighbours ever have those bytes.
    """
    order = np.argsort(merges.ranks)
    made, keys = merges.made[order], merges.keys[order]
    parts = np.stack([keys // merges.width, keys % merges.width])
    single = np.zeros(int(merges.width), bool)
    single[merges.of_byte] = True
    earlier = (parts < made).all(axis=0) & (single[parts] | np.isin(parts, made)).all(axis=0)
    known = set(merges.of_byte.tolist()) | set(made.tolist()) == set(tokens.values())
    return bool(known and (np.diff(made) > 0).all() and earlier.all() and (merges.counts(list(tokens)) == 1).all())


def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    kept = worker_cache("packing")
    if ("ids", path) not in kept:
        kept["ids", path] = Encoder(path)
    return kept["ids", path]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin it fits.
    Rooms are small integers, so open bins stand in one stack per room."""
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that have open bins, sorted
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        k = bisect.bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms[k]
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(k)
            chosen.append(item)
            room -= length
        else:
            chosen, room = [item], capacity - length
            bins.append(chosen)
        if room:
            if not open_bins[room]:
                bisect.insort(rooms, room)
            open_bins[room].append(chosen)
    return bins


def bin_schema(doc_id: StructField) -> StructType:
    member = StructType([StructField("doc_id", doc_id.dataType), StructField("piece", IntegerType()),
                         StructField("start", LongType()), StructField("length", LongType()),
                         StructField("ids_crc32", LongType())])
    return StructType([StructField("filled", IntegerType()), StructField("ready", BooleanType()),
                       StructField("members", ArrayType(member))])


def bins_of(items: list[list[dict]], filled: np.ndarray, capacity: int, room: int) -> dict[str, list]:
    """Best fit of items that are themselves lists of pieces."""
    out: dict[str, list] = {"filled": [], "ready": [], "members": []}
    for numbers in best_fit(filled, capacity):
        total = int(filled[numbers].sum())
        out["filled"].append(total)
        out["ready"].append(total >= capacity - room)
        out["members"].append([m for n in numbers for m in items[n]])
    return out


def cut(doc_id, ids: bytes, capacity: int) -> Iterator[dict]:
    n = len(ids) // 4
    start, piece = 0, 0
    while start < n:
        length = (n % capacity or capacity) if not start else capacity
        yield {"doc_id": doc_id, "piece": piece, "start": start, "length": length,
               "ids_crc32": zlib.crc32(ids[4 * start:4 * (start + length)])}
        start, piece = start + length, piece + 1


def parts(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about ``most`` bytes of text, a text never cut: only
    one stretch at a time becomes Python strings."""
    sizes = np.asarray(pa.compute.binary_length(batch.column("text")))
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        end = min(len(sizes), int(np.searchsorted(ends, done + most)) + 1)
        yield batch.slice(first, end - first)
        first = end


def emitted(rows: dict[str, list], schema: pa.Schema, step: int = 2_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows["filled"]), step):
        yield pa.RecordBatch.from_pydict({k: v[i:i + step] for k, v in rows.items()}, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         room: int = ROOM, per_task: int = PER_TASK, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or vocabulary_path()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = bin_schema(source.schema["doc_id"])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        items: list[list[dict]] = []
        for batch in batches:
            for part in parts(batch):
                full: dict[str, list] = {"filled": [], "ready": [], "members": []}
                for name, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    for piece in cut(name, ids + end, capacity):
                        if piece["length"] == capacity:
                            for k, v in (("filled", capacity), ("ready", True), ("members", [piece])):
                                full[k].append(v)
                        else:
                            items.append([piece])
                yield from emitted(full, arrow)
            if len(items) > per_task:  # a task holds a bounded number of items
                yield from pack_items(items)
                items = []
        yield from pack_items(items)

    def pack_items(items: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        filled = np.array([sum(m["length"] for m in i) for i in items], np.int64)
        yield from emitted(bins_of(items, filled, capacity, room), arrow)

    def next_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[list[dict]] = []
        for batch in batches:
            items += batch.column("members").to_pylist()
            if len(items) > 2 * per_task:
                yield from pack_items(items)
                items = []
        yield from pack_items(items)

    round_bins = stage(source.mapInArrow(first_round, schema), "pack-0")
    done = [round_bins.filter("ready")]
    rest = round_bins.filter("not ready")
    left, tasks = rest.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in range(1, 64):
        if not left:
            break
        last_tasks, tasks = tasks, max(1, -(-tasks // 4), -(-left // per_task))
        # neighbours of like length stay apart: rows are dealt by a hash, not by range
        dealt = rest.select("members").repartition(tasks, F.xxhash64("members"))
        packed = stage(dealt.mapInArrow(next_round, schema), f"pack-{n}")
        done.append(packed.filter("ready"))
        rest = packed.filter("not ready")
        before, left = left, rest.count()
        if tasks == 1 or (tasks >= last_tasks and left > 0.98 * before):
            break
    if left:
        done.append(rest)
    sequences = done[0]
    for part in done[1:]:
        sequences = sequences.unionByName(part)
    numbered = sequences.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    offsets = F.aggregate("members", F.array(F.lit(0).cast("long")),
                          lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m["length"])))
    opened = numbered.withColumn("starts", offsets).select(
        "sequence_id", "starts", F.posexplode("members").alias("i", "m"))
    return opened.select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id",
        F.get("starts", F.col("i")).alias("offset"))

