"""LM scoring by a hierarchical Pitman-Yor model of words.

Every context word of the training tokens has a restaurant; customers are the words
that follow it, dishes the distinct ones.  All restaurants share one parent, the root,
whose customers are the children's tables; the root serves from a uniform base over
the V known words and one unknown, and holds one table per word.

Seating is sampled by Gibbs: in each sweep every dish that several customers ordered
draws its number of tables anew, however many customers it has, given the other
dishes' tables.  Up to ``EXACT`` customers the weights are exact; above, the number is
binomial (or a Poisson number of a gamma mean) with the mean and variance of these
weights to the leading order.  The dishes of one sweep are drawn together, given the
restaurants' table totals and the root's counts, which are exchanged between sweeps.
A dish that one customer ordered has one table always.
Scores average the predictive probabilities of the sweeps after the first:

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) P_root(w)

and P_root(w) after a context that no training text has.  The probabilities of one
context sum to one over the V words and the unknown one.

Spark does the gathering: three passes over the texts.  The first finds frequent
words (those with 1/CONTEXTS of the tokens: at most CONTEXTS of them, told to all
tasks); this share decides where a dish is kept, not whether.  The second counts: per
batch each (word, context) once, packed by shard.  After a frequent context, dishes
go by their word (``Dishes``), so the word's root customers are at one place; those of
a frequent word are dealt by word and context, and its totals are summed up over the
shards.  After a rare context, dishes go by their context (``Rare``), so the whole
restaurant is at one place; it tells the shards of its rare words how many tables
each has there, and is told their root customers, in every state of the seating.  The
third pass sends each batch's tokens to the shards and returns sums per document; the
most frequent dishes (1/``TOLD`` of the tokens each) are scored where they are met, so
no dish is sent more often than that share.

The discount comes from the counts of counts, n1 / (n1 + 2 n2).  Everything is
fixed by the seed.  Defined cases: a null or empty text is its end token; rows are
scored one by one, so repeated ids are no matter; a null doc_id is learned from,
and not held out; with no training text V and N are 0 and all words unknown.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_at_exit, delete_now, fresh_path
from ..session import staged as stage
from .common import held_out, shuffle_width, text_bytes, worker_cache
from .words import mixed, word_hashes

CONTEXTS = 1 << 15
TOLD = 1 << 17
BATCH, SHARD_BYTES = 1_000_000, 20_000_000
#: More shards than these hold SHARD_BYTES / 2 of text at least: every two shards may write to each other.
FEW_SHARDS = 64
MOST_DOCS = 1 << 16
#: Bytes of payload (before packing) that go to Spark at once.
PIECE = 1 << 20
#: A task that has counted more words than these tells them and begins anew.
MOST_WORDS = 2_000_000
SWEEPS = 4
#: Up to so many customers of a dish its number of tables is drawn from exact weights.
EXACT = 256
THETA = 1.0
SEED = 7
START, END = np.uint64(1), np.uint64(2)

PACKET = "kind int, key long, batch long, payload binary"
#: Kinds of packets.  Models: DISHES after frequent contexts and RESTAURANTS of rare ones.  Entries of a
#: batch: AFTER a frequent context, and after a rare one OFTEN (frequent words) and SELDOM (others).
#: Mail between the shards: TABLES of a restaurant's words, their ROOT customers, a shard's own LEDGER of
#: the tables it was told of; and VECTOR, sums that the driver adds up.
DISHES, AFTER, OFTEN, SELDOM, RESTAURANTS, TABLES, ROOT, LEDGER, VECTOR = range(9)
#: In ``Rare``, words from here on are names of the shard, those below are places of frequent words.
NAMED = 1 << 16
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def tokens_of(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of consecutive texts (words, then END), their texts' numbers, and the tokens before."""
    words = np.insert(found, counts[1:], END)
    texts = np.repeat(np.arange(len(counts) - 1), np.diff(counts) + 1)
    before = np.append(START, words[:-1])
    before[before == END] = START
    return words, texts, before


def position(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 if it has none."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def rows_of(rows) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["kind", "key", "batch", "payload"])


def packed(payload: bytes) -> bytes:
    """Spark holds and moves the packed bytes; only the Python that reads a payload unpacks it."""
    return len(payload).to_bytes(8, "little") + pa.compress(payload, "zstd", asbytes=True)


def unpacked(payload: pa.BinaryScalar) -> pa.Buffer:
    buffer = payload.as_buffer()
    size = int.from_bytes(buffer[:8], "little")
    return pa.decompress(buffer[8:], size, "zstd") if size else pa.py_buffer(b"")


def pieces(rows: Iterable) -> Iterator[pa.RecordBatch]:
    """Packets with packed payloads, a few at a time."""
    out, size = [], 0
    for kind, key, batch, payload in rows:
        out.append((kind, key, batch, packed(payload)))
        size += len(payload)
        if size >= PIECE:
            yield rows_of(out)
            out, size = [], 0
    if out:
        yield rows_of(out)


def trimmed() -> None:
    """Give the freed memory of this worker back: the next task may run in another one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table_of(rows) -> pa.Table:
    trimmed()
    return pa.Table.from_batches(pieces(rows)) if rows else pa.table(
        {"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()),
         "payload": pa.array([], pa.binary())})


class Batch:
    """Tokens of some documents, kept until there are enough to send."""

    def __init__(self) -> None:
        self.ids, self.held, self.lengths = [], [], []
        self.words, self.before, self.docs = [], [], []
        self.size = 0

    def add(self, ids, held, words, before, texts) -> None:
        self.docs.append((texts + len(self.ids)).astype(np.int32))
        self.ids += ids
        self.held += held
        self.lengths += np.bincount(texts, minlength=len(ids)).tolist()
        self.words.append(words)
        self.before.append(before)
        self.size += len(words)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens, the tokens before and their documents; the batch lets them go."""
        out = []
        for pieces in (self.words, self.before, self.docs):
            out.append(np.concatenate(pieces))
            pieces.clear()
        return tuple(out)


def batches_of(batches: Iterator[pa.RecordBatch], training_only: bool) -> Iterator[tuple[int, Batch]]:
    from pyspark import TaskContext

    worker_cache("lm")
    base, made, out = TaskContext.get().partitionId() << 24, 0, Batch()
    for batch in batches:
        if training_only:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
        ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for first, end, found, counts in word_hashes(batch.column("text")):
            words, texts, before = tokens_of(found, counts)
            for low in range(0, end - first, MOST_DOCS // 2):
                part = slice(low, low + MOST_DOCS // 2)
                inside = (texts >= low) & (texts < low + MOST_DOCS // 2) if end - first > MOST_DOCS // 2 else slice(None)
                out.add(ids[first:end][part], held[first:end][part], words[inside], before[inside], texts[inside] - low)
                if out.size >= BATCH or len(out.ids) >= MOST_DOCS // 2:
                    yield base + made, out
                    made, out = made + 1, Batch()
                    trimmed()
    if out.ids:
        yield base + made, out
    del out
    trimmed()


def grouped(words: np.ndarray, others: np.ndarray, values: np.ndarray, other: str = "<u2") -> bytes:
    """Entries sorted by word: each word once, with its contexts (or what else ``others`` are) and values."""
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    times = np.diff(np.append(first, len(words)))
    return b"".join((np.array([len(first), len(words)], "<i8").tobytes(), words[first].astype("<u8").tobytes(),
                     times.astype("<u4").tobytes(), others.astype(other).tobytes(), values.tobytes()))


def arrays(payload, *parts: tuple[str, int], at: int = 0) -> list[np.ndarray]:
    """Arrays of these types and lengths, one after the other."""
    out = []
    for kind, n in parts:
        out.append(np.frombuffer(payload, kind, n, at) if n else np.zeros(0, kind))
        at += out[-1].nbytes
    return out


def ungrouped(payload, kind: str, other: str = "<u2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(payload, "<i8", 2).tolist()
    words, times, others, values = arrays(payload, ("<u8", n), ("<u4", n), (other, m), (kind, m), at=16)
    return np.repeat(words, times), others, values


def dealt(kind: int, number: int, shards: int, shard: np.ndarray, words, others, values, other: str = "<u2") -> list:
    """Packets of a batch's entries, sorted by word, for each shard."""
    order = np.argsort(shard, kind="stable")
    words, others, values = words[order], others[order], values[order]
    limits = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(kind, s, number, grouped(words[low:high], others[low:high], values[low:high], other))
            for s, (low, high) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist())) if low < high]


def in_bytes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with their counts, a larger count as several entries of 255 at most."""
    times = np.maximum((n + 254) // 255, 1)
    values = np.full(times.sum(), 255, np.uint8)
    values[np.cumsum(times) - 1] = n - 255 * (times - 1)
    return np.repeat(keys, times), values


def shard_of(words: np.ndarray, frequent: np.ndarray, contexts: np.ndarray, shards: int) -> np.ndarray:
    """By word; by word and context for frequent words."""
    return shard_at(np.where(frequent, mixed(words + contexts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), words), shards)


def shard_at(words: np.ndarray, shards: int) -> np.ndarray:
    """Of rare words and rare contexts; in their order."""
    return (((words >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def frequent_words(docs: DataFrame, contexts: int) -> tuple[np.ndarray, int]:
    """Hashes of the words with at least 1/contexts of the training tokens, sorted,
    and the number of those tokens.  Tasks tell all their words, so the counts are exact
    however the texts are partitioned."""
    def told_of(words, counts, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.append(words, START).astype(np.int64)), pa.array(np.append(counts, 0).astype(np.int64)),
            pa.array(np.append(np.zeros(len(words), np.int64), size))], ["word", "n", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for _, batch in batches_of(batches, True):
            words, n = np.unique(np.concatenate(batch.words), return_counts=True)
            size += batch.size
            kept, at = np.unique(np.concatenate((kept, words)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(kept)).astype(np.int64)
            if len(kept) > MOST_WORDS:
                yield told_of(kept, counts, size)
                kept, counts, size = kept[:0], counts[:0], 0
        yield told_of(kept, counts, size)

    schema, path = "word long, n long, tokens long", fresh_path(docs.sparkSession, "lm-told")
    docs.mapInArrow(run, schema).write.parquet(path)
    delete_at_exit(docs.sparkSession, path)
    told = docs.sparkSession.read.schema(schema).parquet(path)
    total = told.agg(F.sum("tokens")).first()[0] or 0
    chosen = told.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") * contexts >= total) & (F.col("n") > 1))
    words = np.array([r["word"] for r in chosen.select("word").collect()] + [int(START)], np.int64)
    delete_now(docs.sparkSession, path)
    return np.unique(words.astype(np.uint64)), total


def counted(docs: DataFrame, told, shards: int) -> DataFrame:
    """Training counts: per batch and shard each (word, context) with its count (255 at most per entry).
    The rare words after rare contexts of held-out texts are told too, with a count of 0, so
    that the context's shard learns their root customers."""
    def numbered(batch: Batch):
        """The distinct words and whether they are in a training text; numbers of the tokens and of those before."""
        words, before, docs_at = batch.flat()
        learned = ~np.array(batch.held, bool)[docs_at]
        del docs_at
        distinct, at = np.unique(np.append(words, START), return_inverse=True)
        del words
        at = at.astype(np.int32)
        return distinct, learned, at[:-1], np.where(before == START, at[-1], np.append(at[-1:], at[:-2]))

    def after_frequent(number, distinct, place, at, before_at):
        dishes, n = np.unique((at.astype(np.int64) << 16) | place[before_at], return_counts=True)
        dishes, values = in_bytes(dishes, n)
        word_at, contexts = dishes >> 16, (dishes & 0xFFFF).astype(np.uint16)
        del dishes
        shard = shard_of(distinct[word_at], place[word_at] > 0, contexts, shards)
        return dealt(AFTER, number, shards, shard, distinct[word_at], contexts, values)

    def after_rare(number, distinct, place, at, before_at, learned):
        dishes, found = np.unique((before_at.astype(np.int64) << 32) | at, return_inverse=True)
        dishes, values = in_bytes(dishes, np.bincount(found, learned, len(dishes)).astype(np.int64))
        del found
        contexts, word_at = distinct[dishes >> 32], dishes & 0xFFFFFFFF
        del dishes
        often = place[word_at] > 0
        for kind, part, others, other in ((OFTEN, often, place, "<u2"), (SELDOM, ~often, distinct, "<u8")):
            yield dealt(kind, number, shards, shard_at(contexts[part], shards), contexts[part], others[word_at[part]],
                        values[part], other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = told.value
        for number, batch in batches_of(batches, False):
            distinct, learned, at, before_at = numbered(batch)
            place = position(frequent, distinct) + 1
            yield from pieces(after_frequent(number, distinct, place, at[learned], before_at[learned]))
            rare = (place[before_at] == 0) & (learned | (place[at] == 0))
            for out in after_rare(number, distinct, place, at[rare], before_at[rare], learned[rare]):
                yield from pieces(out)

    return docs.mapInArrow(run, PACKET)


def entries(table, kind: int, value: str, other: str = "<u2") -> list[np.ndarray]:
    """All entries of the packets of a kind."""
    found = [ungrouped(unpacked(x), value, other) for k, x in zip(table.column("kind").to_pylist(), table.column("payload"))
             if k == kind]
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in ("<u8", other, value)]


def merged(key, table):
    """All counts of a shard: words, and dishes sorted by word and context; the restaurants of its rare
    contexts, with dishes sorted by context and word."""
    out, shard = [], shard_in(table)
    words, contexts, counts = entries(table, AFTER, "u1")
    if len(words):
        distinct, at = np.unique(words, return_inverse=True)
        del words
        dishes, at = np.unique((at.astype(np.int64) << 16) | contexts, return_inverse=True)
        n = np.bincount(at, counts, len(dishes))
        times = np.bincount(dishes >> 16, minlength=len(distinct))
        out.append((DISHES, shard, -1, b"".join((
            np.array([len(distinct), len(dishes)], "<i8").tobytes(), distinct.astype("<u8").tobytes(),
            times.astype("<u4").tobytes(), (dishes & 0xFFFF).astype("<u2").tobytes(), n.astype("<u4").tobytes()))))
    one, places, n_one = entries(table, OFTEN, "u1")
    two, words, n_two = entries(table, SELDOM, "u1", "<u8")
    if len(one) or len(two):
        names, at = np.unique(words, return_inverse=True)
        contexts, context_at = np.unique(np.concatenate((one, two)), return_inverse=True)
        dishes, at = np.unique((context_at.astype(np.int64) << 32) | np.concatenate((places.astype(np.int64), NAMED + at)),
                               return_inverse=True)
        n = np.bincount(at, np.concatenate((n_one, n_two)), len(dishes))
        dishes, n = dishes[n > 0], n[n > 0]
        times = np.bincount(dishes >> 32, minlength=len(contexts))
        contexts, times = contexts[times > 0], times[times > 0]
        out.append((RESTAURANTS, shard, -1, b"".join((
            np.array([len(contexts), len(names), len(dishes)], "<i8").tobytes(), contexts.astype("<u8").tobytes(),
            names.astype("<u8").tobytes(), times.astype("<u4").tobytes(), (dishes & 0xFFFFFFFF).astype("<u4").tobytes(),
            n.astype("<u4").tobytes()))))
    return table_of(out)


class Shared:
    """What all shards know of the sweeps so far: arrays over frequent words (place 0:
    all others) and totals.  Grows by one sweep at a time."""

    def __init__(self, frequent: np.ndarray, tokens: int):
        self.frequent, self.tokens = frequent, tokens
        self.words = 0          # V
        self.discount = self.root_discount = 0.75
        self.customers = np.zeros(len(frequent) + 1)       # c_u
        self.word_counts = np.zeros(len(frequent) + 1)     # training count of a frequent word
        self.tables: list[np.ndarray] = []                 # t_u before each sweep and after the last
        self.root: list[np.ndarray] = []                   # root customers of a frequent word
        self.root_customers: list[float] = []

    def root_p(self, counts: np.ndarray, k: int) -> np.ndarray:
        """P_root of words with these root customers (0: unknown) in the state of sweep k."""
        free = (THETA + self.root_discount * self.words) / (self.words + 1)
        return (np.where(counts > 0, counts - self.root_discount, 0.0) + free) / (THETA + self.root_customers[k])

    def back_off(self, k: int) -> np.ndarray:
        """Weight of the root after each frequent context."""
        out = (THETA + self.discount * self.tables[k]) / (THETA + self.customers)
        out[0] = 1.0
        return out


def seatings(d: float) -> np.ndarray:
    """Logarithms of how many ways, weighted by the discount, n customers have t tables, for
    t from 1 to n; those of n begin at n (n - 1) / 2.  A customer joins with weight n - d t."""
    kept = worker_cache("lm")
    if kept.get("discount") != d:
        rows = [np.zeros(1)]
        for n in range(1, EXACT):
            joins = np.log(n - d * np.arange(1, n + 1)) + rows[-1]
            rows.append(np.logaddexp(np.append(joins, -np.inf), np.append(-np.inf, rows[-1])))
        kept["discount"], kept["seatings"] = d, np.concatenate(rows)
    return kept["seatings"]


def moments(n: np.ndarray, d: float, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables, but the first, of many customers where each new
    table has this weight: tables are a Poisson number of independent sizes, given their sum n."""
    low, high = np.full(len(n), -700.0), np.zeros(len(n))  # log of 1 - x, where the sizes' sum is n on average
    for _ in range(60):
        y = (low + high) / 2
        above = weight * -np.expm1(y) > n * np.exp((1 - d) * y)
        low, high = np.where(above, y, low), np.where(above, high, y)
    y = (low + high) / 2
    mean = weight / d * -np.expm1(d * y)
    x = -np.expm1(y)
    return mean, np.maximum(mean - n / (1 + (1 - d) * x * np.exp(-y)), 1e-9)


def drawn_tables(rng, n: np.ndarray, d: float, spread: np.ndarray, root: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Tables of dishes with n customers each, drawn given all other dishes: t with weight
    seatings(n, t) times the product over j < t of (spread + d j) (root + j) / (total + j)."""
    out = np.empty(len(n), np.int64)
    few, ways = np.flatnonzero(n <= EXACT), seatings(d)
    u = rng.random(len(few))
    ends = np.cumsum(n[few])
    low = 0
    while low < len(few):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 17), "right")))
        at, size = few[low:high], n[few[low:high]]
        first = np.cumsum(size) - size
        j = np.arange(size.sum()) - np.repeat(first, size)
        weight = np.log(np.repeat(spread[at], size) + d * j)
        weight += np.log(np.maximum(np.repeat(root[at], size) + j, 1e-300) / (np.repeat(total[at], size) + j))
        weight[first] = 0.0  # the first table is there in any case
        weight = np.cumsum(weight)
        weight -= np.repeat(weight[first], size)
        weight += ways[np.repeat(size * (size - 1) // 2, size) + j]
        weight -= np.repeat(np.maximum.reduceat(weight, first), size)
        np.exp(weight, out=weight)
        weight /= np.repeat(np.add.reduceat(weight, first), size)
        chosen = np.searchsorted(np.cumsum(weight), np.arange(len(at)) + u[low:high])
        out[at] = np.clip(chosen - first, 0, size - 1) + 1
        low = high
    many = np.flatnonzero(n > EXACT)
    if len(many):
        c, spread, root, total = n[many], spread[many], root[many], total[many]
        # the mean t where t - 1 tables are expected at the weight that the next one has there
        least, most = np.zeros(len(c)), c - 1.0
        for _ in range(40):
            t = (least + most) / 2
            weight = (spread + d * (t + 1)) * (root + t + 1) / (total + t + 1)
            above = moments(c, d, weight)[0] > t
            least, most = np.where(above, t, least), np.where(above, most, t)
        mean = (least + most) / 2
        weight = (spread + d * (mean + 1)) * (root + mean + 1) / (total + mean + 1)
        grows = d / (spread + d * (mean + 1)) + 1 / (root + mean + 1) - 1 / (total + mean + 1)
        variance = moments(c, d, weight)[1]
        variance = variance / np.maximum(1 - variance * grows, 0.05)
        # a binomial number has a variance below its mean, a Poisson number of a gamma mean one above
        p = np.clip(1 - variance / np.maximum(mean, 1e-9), 1e-6, 1 - 1e-9)
        tries = np.maximum(np.rint(mean / p), 1)
        narrow = rng.binomial(tries.astype(np.int64), np.minimum(mean / tries, 1.0))
        over = np.maximum(variance / np.maximum(mean, 1e-9) - 1, 1e-6)
        wide = rng.poisson(rng.gamma(np.maximum(mean, 1e-9) / over, over))
        out[many] = 1 + np.minimum(np.where(variance > mean, wide, narrow), c - 1)
    return out


class Dishes:
    """The dishes of one shard after frequent contexts and their seating.  Context 0 stands for all rare
    contexts: ``rare`` has, for each state, the tables that each word of the shard has in their
    restaurants (none: all its customers come to the root)."""

    def __init__(self, payload, shared: Shared, rare: list[np.ndarray] | None = None):
        n, m = np.frombuffer(payload, "<i8", 2).tolist()
        self.words, self.times, contexts, counts = arrays(payload, ("<u8", n), ("<u4", n), ("<u2", m), ("<u4", m), at=16)
        self.contexts, self.counts = contexts.astype(np.int64), counts.astype(np.int64)
        self.shared, self.rare = shared, rare
        self.word_at = np.repeat(np.arange(n), self.times)
        self.place = position(shared.frequent, self.words) + 1
        self.own = self.contexts > 0
        self.tables = np.where(self.own, 1, self.counts)  # root customers that the dish sends
        self.many = np.flatnonzero(self.own & (self.counts > 1))
        self.pool(0)

    def pool(self, k: int) -> None:
        """The rare contexts' tables in state k; those of a frequent word are in what is told of it."""
        if self.rare is not None and k < len(self.rare):
            pooled = np.flatnonzero(~self.own)
            at = self.word_at[pooled]
            self.tables = self.tables.copy()
            self.tables[pooled] = np.where(self.place[at] > 0, 0, self.rare[k][at])

    def root_customers(self) -> np.ndarray:
        """Per word of the shard (a part only for frequent words)."""
        return np.bincount(self.word_at, self.tables, len(self.words))

    def whole_root(self, k: int) -> np.ndarray:
        """Per word, root customers in the state of sweep k: here, or told if frequent."""
        return np.where(self.place > 0, self.shared.root[k][self.place], self.root_customers())

    @property
    def owners(self) -> np.ndarray:
        """Dish of each table, of the dishes with several customers."""
        return np.repeat(np.arange(len(self.many)), self.tables[self.many])

    @property
    def sizes(self) -> np.ndarray:
        """One seating with these tables: all but the first of a dish have one customer.  The
        model sums over the seatings with equal numbers of tables, so no result depends on it."""
        tables = self.tables[self.many]
        sizes = np.ones(tables.sum(), np.int64)
        sizes[np.cumsum(tables) - tables] += self.counts[self.many] - tables
        return sizes

    def sweep(self, k: int, shard: int) -> None:
        self.seat(k, shard)
        self.pool(k + 1)

    def seat(self, k: int, shard: int) -> None:
        if not len(self.many):
            return
        shared, own = self.shared, self.tables[self.many]
        free = (THETA + shared.root_discount * shared.words) / (shared.words + 1)
        drawn = drawn_tables(
            np.random.default_rng([SEED, k, shard]), self.counts[self.many], shared.discount,
            THETA + shared.discount * (shared.tables[k][self.contexts[self.many]] - own),
            self.whole_root(k)[self.word_at[self.many]] - own - shared.root_discount + free,
            THETA + shared.root_customers[k] - own)
        self.tables = self.tables.copy()
        self.tables[self.many] = drawn

    def predictive(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean probability of every dish, and P_root of every word in each averaged state."""
        shared, total, roots = self.shared, np.zeros(len(self.counts)), []
        for k in range(SWEEPS):
            self.sweep(k, shard)
            if k == 0:
                continue
            root = shared.root_p(self.whole_root(k + 1), k + 1)
            roots.append(root)
            seated = np.where(self.own, (self.counts - shared.discount * self.tables) /
                              (THETA + shared.customers[self.contexts]), 0.0)
            total += seated + shared.back_off(k + 1)[self.contexts] * root[self.word_at]
        return total / len(roots), np.array(roots)


class Rare:
    """The restaurants of a shard's rare contexts and their seating.  ``roots`` has, for each state, the
    root customers of the shard's names: the rare words that follow its contexts."""

    def __init__(self, payload, shared: Shared, roots: list[np.ndarray]):
        n, names, m = np.frombuffer(payload, "<i8", 3).tolist()
        self.contexts, self.names, times, self.words, counts = arrays(
            payload, ("<u8", n), ("<u8", names), ("<u4", n), ("<u4", m), ("<u4", m), at=24)
        self.counts, self.shared, self.roots = counts.astype(np.int64), shared, roots
        self.context_at = np.repeat(np.arange(n), times)
        self.customers = np.bincount(self.context_at, self.counts, n)
        self.frequent = len(shared.frequent) + 1
        #: among the frequent words' places and then the names
        self.word_at = self.words.astype(np.int64)
        self.word_at[self.word_at >= NAMED] += self.frequent - NAMED
        self.tables = np.ones(m, np.int64)
        self.many = np.flatnonzero(self.counts > 1)

    def told(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of frequent words, and of the names."""
        sums = np.bincount(self.word_at, tables, self.frequent + len(self.names)).astype(np.int64)
        return sums[:self.frequent], sums[self.frequent:]

    def inside(self) -> np.ndarray:
        return np.bincount(self.context_at, self.tables, len(self.contexts))

    def whole_root(self, k: int) -> np.ndarray:
        return np.concatenate((self.shared.root[k], self.roots[k]))

    def sweep(self, k: int, shard: int) -> None:
        if not len(self.many):
            return
        shared, own = self.shared, self.tables[self.many]
        free = (THETA + shared.root_discount * shared.words) / (shared.words + 1)
        drawn = drawn_tables(
            np.random.default_rng([SEED, k, shard, 1]), self.counts[self.many], shared.discount,
            THETA + shared.discount * (self.inside()[self.context_at[self.many]] - own),
            self.whole_root(k)[self.word_at[self.many]] - own - shared.root_discount + free,
            THETA + shared.root_customers[k] - own)
        self.tables = self.tables.copy()
        self.tables[self.many] = drawn

    def predictive(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean probability of every dish, and in each averaged state the root's weight after every
        context and P_root of the frequent words and the names."""
        shared, total, backs, roots = self.shared, np.zeros(len(self.counts)), [], []
        for k in range(SWEEPS):
            self.sweep(k, shard)
            if k == 0:
                continue
            backs.append((THETA + shared.discount * self.inside()) / (THETA + self.customers))
            roots.append(shared.root_p(self.whole_root(k + 1), k + 1))
            total += (self.counts - shared.discount * self.tables) / (THETA + self.customers[self.context_at])
            total += backs[-1][self.context_at] * roots[-1][self.word_at]
        return total / len(roots), np.array(backs), np.array(roots)


EMPTY = np.zeros(3, "<i8").tobytes()


def payload_of(table, kind: int):
    """The shard's model of this kind; an empty one if it has none."""
    found = [x for k, b, x in zip(table.column("kind").to_pylist(), table.column("batch").to_pylist(), table.column("payload"))
             if k == kind and b < 0]
    return unpacked(found[0]) if found else EMPTY


def shard_in(*tables) -> int:
    return next(t.column("key")[0].as_py() for t in tables if t.num_rows)


def mail_of(table, kind: int) -> list[tuple[int, pa.Buffer]]:
    return sorted(((b, unpacked(x)) for k, b, x in zip(
        table.column("kind").to_pylist(), table.column("batch").to_pylist(), table.column("payload")) if k == kind),
        key=lambda x: x[0])


def changes(old: np.ndarray, new: np.ndarray) -> bytes:
    """Where tables or root customers are more than at first, and how many more."""
    at = np.flatnonzero(new > old)
    return b"".join((at.astype("<u4").tobytes(), (new[at] - old[at]).astype("<u4").tobytes()))


def changed(old: np.ndarray, payload, start: int = 0) -> None:
    if payload.size:
        at, more = np.frombuffer(payload, "<u4").reshape(2, -1).astype(np.int64)
        old[start + at] += more


def roots_told(mail) -> tuple[list[np.ndarray], np.ndarray]:
    """From the shards of its words (in their order, which is that of the names): the root customers of a
    shard's names in each state, and their training counts, which come with state 0."""
    first, later = [], []
    for at, payload in mail_of(mail, ROOT):
        (later if at >> 32 else first).append((at, payload))
    parts = [np.frombuffer(x, "<u4").reshape(2, -1) for _, x in first] or [np.zeros((2, 0), "<u4")]
    root, counts = np.concatenate(parts, axis=1).astype(np.int64)
    starts = dict(zip((at for at, _ in first), np.cumsum([0, *(x.shape[1] for x in parts)]).tolist()))
    roots = {0: root}
    for at, payload in later:
        if at >> 32 not in roots:
            roots[at >> 32] = root.copy()
        changed(roots[at >> 32], payload, starts[at & 0xFFFFFFFF])
    return [roots.get(k, root) for k in range(SWEEPS + 1)], counts


def ledgers(mail, n: int) -> tuple[list[tuple[int, np.ndarray]], list[np.ndarray]]:
    """From a shard's ledger: who asks for the root customers of which of its n words (twice the place,
    and one more for the place of a word that is not there), and the tables that these have in
    rare contexts' restaurants, in each state."""
    asked, tables = [], []
    for k, payload in mail_of(mail, LEDGER):
        if k:
            tables.append(tables[0].copy())
            changed(tables[-1], payload)
            continue
        tables.append(arrays(payload, ("<u4", n))[0].astype(np.int64))
        at = 4 * n
        while at < payload.size:
            sender, size, width = np.frombuffer(payload, "<i8", 3, at).tolist()
            asked.append((sender, np.cumsum(arrays(payload, (f"<u{width}", size), at=at + 24)[0], dtype=np.int64)))
            at += 24 + width * size
    return asked, tables


def rare_sums(told, sweeps: int, shards: int):
    """The rare contexts' shards after these sweeps: the tables of their words."""
    def run(key, model, mail):
        shared: Shared = told.value
        shard = shard_in(model, mail)
        rare = Rare(payload_of(model, RESTAURANTS), shared, roots_told(mail)[0])
        for k in range(sweeps):
            rare.sweep(k, shard)
        often, named = rare.told(rare.tables)
        names = rare.names
        if sweeps:  # only what is not as at first
            named = named - rare.told(np.ones(len(rare.tables), np.int64))[1]
            names, named = names[named > 0], named[named > 0]
        limits = np.searchsorted(shard_at(names, shards), np.arange(shards + 1)).tolist()
        out = [(TABLES, s, shard, b"".join((np.array([high - low], "<i8").tobytes(), names[low:high].astype("<u8").tobytes(),
                                            named[low:high].astype("<u4").tobytes())))
               for s, (low, high) in enumerate(zip(limits[:-1], limits[1:])) if low < high]
        n = rare.frequent
        vector = np.zeros((2 if sweeps else 4) * n + 6, "<i8")
        vector[n:2 * n] = often
        vector[-6:] = [often.sum(), 0, (rare.counts == 1).sum(), (rare.counts == 2).sum(), 0, 0]
        return table_of([*out, (VECTOR, shard, sweeps, vector.tobytes())])

    return run


def word_sums(told, sweeps: int):
    """The words' shards after these sweeps: root customers for those who ask, and sums for all."""
    def run(key, model, mail):
        shared: Shared = told.value
        shard, payload = shard_in(model, mail), payload_of(model, DISHES)
        n_words = int(np.frombuffer(payload, "<i8", 1)[0])
        words = arrays(payload, ("<u8", n_words), at=16)[0]
        asked, tables = ledgers(mail, n_words)
        now, book = (tables[0].copy() if sweeps and tables else np.zeros(n_words, np.int64)), []
        for sender, sent in mail_of(mail, TABLES):
            size = int(np.frombuffer(sent, "<i8", 1)[0])
            names, told_tables = arrays(sent, ("<u8", size), ("<u4", size), at=8)
            at = np.searchsorted(words, names)
            there = np.append(words, np.uint64(0))[at] == names if n_words else np.zeros(size, bool)
            now += np.bincount(at[there], told_tables[there], n_words).astype(np.int64)
            if not sweeps:
                at = 2 * at + ~there
                asked.append((sender, at))
                steps = np.diff(at, prepend=0)
                width = 2 if steps.max() < 1 << 16 else 4
                book += [np.array([sender, size, width], "<i8").tobytes(), steps.astype(f"<u{width}").tobytes()]
        dishes = Dishes(payload, shared, [*tables, now])
        first = dishes.root_customers()
        for k in range(sweeps):
            dishes.sweep(k, shard)
        root, often = dishes.root_customers(), dishes.place > 0
        counts = np.bincount(dishes.word_at, dishes.counts, n_words)
        out = [(LEDGER, shard, sweeps, changes(tables[0], now) if sweeps and tables else b"".join(
            (now.astype("<u4").tobytes(), *book)))]
        for sender, at in asked:
            of, there = np.minimum(at >> 1, max(n_words - 1, 0)), at % 2 == 0
            then, told_root, n = (np.where(there, x[of], 0) if n_words else np.zeros(len(at)) for x in (first, root, counts))
            letter = changes(then, told_root) if sweeps else np.concatenate((told_root, n)).astype("<u4").tobytes()
            if letter or not sweeps:  # no letter: as at first
                out.append((ROOT, sender, (sweeps << 32) | shard, letter))
        n = len(shared.frequent) + 1
        # after the vectors: root customers, rare words, and n1 and n2 of dishes and of rare words
        parts = [np.bincount(dishes.contexts, dishes.tables, n), np.bincount(dishes.place[often], root[often], n)]
        if not sweeps:
            word_counts = np.bincount(dishes.place[dishes.word_at], dishes.counts, n)
            word_counts[0] = 0
            parts += [np.bincount(dishes.contexts, dishes.counts, n), word_counts]
        parts.append([root.sum(), (~often).sum(), (dishes.counts[dishes.own] == 1).sum(),
                      (dishes.counts[dishes.own] == 2).sum(), (root[~often] == 1).sum(), (root[~often] == 2).sum()])
        return table_of([*out, (VECTOR, shard, sweeps, np.concatenate(parts).astype("<i8").tobytes())])

    return run


def shards_for(width: int, size: int) -> int:
    """Shards for texts of this size: as many as the shuffle is wide, if they are not too small or too large."""
    return max(min(width, max(FEW_SHARDS, 2 * size // SHARD_BYTES)), -(-size // SHARD_BYTES))


def homes_of(spark, shards: int) -> list[int]:
    """A number for every shard by which Spark deals each to a partition of its own. Any other numbers
    that differ give the same results, with several shards in some partitions and none in others."""
    found = spark.range(32 * shards).groupBy(F.pmod(F.hash("id"), F.lit(shards)).alias("at")).agg(F.min("id").alias("id"))
    known = {r["at"]: r["id"] for r in found.collect()}
    return [known.get(s, 32 * shards + s) for s in range(shards)]


def at_home(packets: DataFrame, homes: list[int]) -> DataFrame:
    """The packets with their shard's number; documents of a batch keep their key, which is below 0."""
    numbers = F.lit(homes).cast("array<bigint>")
    return packets.withColumn("home", F.when(F.col("key") < 0, F.col("key")).otherwise(
        F.get(numbers, F.col("key").cast("int"))))


def exchanged(model: DataFrame, mail: DataFrame, shared: Shared, sweeps: int, homes: list[int]) -> DataFrame:
    """Run the shards up to this many sweeps, add what all must know of the state, and return
    the mail with what single shards must."""
    told = model.sparkSession.sparkContext.broadcast(shared)
    n, shards = len(shared.frequent) + 1, len(homes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 if sweeps else 4) * n + 6, "<i8")
        for batch in batches:
            for sums in batch.column("payload"):
                total += np.frombuffer(unpacked(sums), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([packed(total.tobytes())], pa.binary())], ["payload"])

    def both(kind: int, letters: DataFrame, run) -> DataFrame:
        return stage(model.filter(F.col("kind") == kind).groupBy("home").cogroup(
            at_home(letters, homes).groupBy("home")).applyInArrow(run, PACKET), "lm-mail")

    sent = both(RESTAURANTS, mail.filter(F.col("kind") == ROOT), rare_sums(told, sweeps, shards))
    back = both(DISHES, mail.filter(F.col("kind") == LEDGER).unionByName(sent.filter(F.col("kind") == TABLES)),
                word_sums(told, sweeps))
    # one vector per shard, of at most four numbers per frequent context, added up in three steps
    width = max(1, min(32, shuffle_width(model.sparkSession) // 8))
    vectors = sent.unionByName(back).filter(F.col("kind") == VECTOR).select("payload").mapInArrow(
        add, "payload binary").repartition(width).mapInArrow(add, "payload binary").collect()
    flat = sum((np.frombuffer(unpacked(pa.scalar(bytes(r["payload"]))), "<i8") for r in vectors), np.zeros((2 if sweeps else 4) * n + 6, "<i8")).astype(float)
    told.unpersist()
    totals = flat[-6:]
    shared.tables.append(flat[:n])
    shared.root.append(flat[n:2 * n])
    shared.root_customers.append(totals[0])
    if not sweeps:
        shared.customers, shared.word_counts = flat[2 * n:3 * n], flat[3 * n:4 * n]
        shared.words = int(totals[1] + (shared.word_counts > 0).sum())
        for name, one, two in (("discount", 2, 3), ("root_discount", 4, 5)):
            n1, n2 = totals[one], totals[two]
            if n1 and n2:
                setattr(shared, name, min(0.95, max(0.05, n1 / (n1 + 2 * n2))))
    return mail.unionByName(back.filter(F.col("kind") != VECTOR))


def told_dishes(model: DataFrame, mail: DataFrame, told, most: int, homes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (word's place, context) and log10 probabilities of dishes with 1/most of the tokens."""
    def run(key, model, mail):
        payload = payload_of(model, DISHES)
        dishes = Dishes(payload, told.value, ledgers(mail, int(np.frombuffer(payload, "<i8", 1)[0]))[1])
        chosen = (dishes.counts * most >= told.value.tokens) & (dishes.place[dishes.word_at] > 0) & dishes.own
        p = np.log10(dishes.predictive(shard_in(model, mail))[0][chosen])
        keys = (dishes.place[dishes.word_at][chosen] << 16) | dishes.contexts[chosen]
        return pa.table({"key": pa.array(keys, pa.int64()), "p": pa.array(p, pa.float64())})

    found = model.filter(F.col("kind") == DISHES).groupBy("home").cogroup(
        at_home(mail.filter(F.col("kind") == LEDGER), homes).groupBy("home")).applyInArrow(run, "key long, p double").toArrow()
    keys, p = found.column("key").to_numpy(), found.column("p").to_numpy()
    order = np.argsort(keys)
    return keys[order], p[order]


def sent_tokens(docs: DataFrame, told, dishes, shards: int) -> DataFrame:
    """Per batch: tokens for each shard, and the documents with what is scored here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: Shared = told.value
        keys, p = dishes.value
        unit = np.log10(shared.tokens + shared.words + 1)
        for number, batch in batches_of(batches, False):
            words, before, docs_at = batch.flat()
            distinct, at = np.unique(words, return_inverse=True)
            place = position(shared.frequent, distinct) + 1
            context = position(shared.frequent, before) + 1
            found = position(keys, (place[at] << 16) | context) if len(keys) else np.full(len(words), -1)
            here = found >= 0
            n = len(batch.ids)
            base = np.bincount(docs_at[here], np.log10(shared.word_counts[place[at[here]]] + 1) - unit, n)
            score = np.bincount(docs_at[here], p[found[here]], n)
            known = np.bincount(docs_at[here], minlength=n)
            # a key of the batch's own: no task reads the documents of all batches
            out = [(0, -2 - number, number, b"".join((
                np.array([n], "<i8").tobytes(), np.array([i is not None for i in batch.ids], "u1").tobytes(),
                np.array([i if i is not None else 0 for i in batch.ids], "<i8").tobytes(),
                np.array(batch.held, "u1").tobytes(), np.array(batch.lengths, "<i8").tobytes(),
                summed(np.arange(n), base, known, score))))]
            at, context, docs_at, before = at[~here], context[~here], docs_at[~here].astype("<u2"), before[~here]
            part = np.flatnonzero(context > 0)
            part = part[np.argsort(at[part], kind="stable")]
            contexts = context[part].astype(np.uint16)
            out += dealt(AFTER, number, shards, shard_of(distinct[at[part]], place[at[part]] > 0, contexts, shards),
                         distinct[at[part]], contexts, docs_at[part])
            for kind, often, others, other in ((OFTEN, True, place, "<u2"), (SELDOM, False, distinct, "<u8")):
                part = np.flatnonzero((context == 0) & ((place[at] > 0) == often))
                part = part[np.argsort(before[part], kind="stable")]
                of = before[part]
                out += dealt(kind, number, shards, shard_at(of, shards), of, others[at[part]],
                             docs_at[part], other)
            yield from pieces(out)

    return docs.mapInArrow(run, PACKET)


def summed(docs: np.ndarray, base: np.ndarray, known: np.ndarray, score: np.ndarray) -> bytes:
    return b"".join((np.array([len(docs)], "<i8").tobytes(), docs.astype("<u4").tobytes(), base.astype("<f8").tobytes(),
                     known.astype("<u4").tobytes(), score.astype("<f8").tobytes()))


def unsummed(payload, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, "<i8", 1, at)[0])
    at += 8
    return (np.frombuffer(payload, "<u4", n, at), np.frombuffer(payload, "<f8", n, at + 4 * n),
            np.frombuffer(payload, "<u4", n, at + 12 * n), np.frombuffer(payload, "<f8", n, at + 16 * n))


def after_frequent(model, mail, shared: Shared, shard: int):
    """Words and frequent contexts -> the words' training counts, and scores."""
    payload = payload_of(model, DISHES)
    dishes = Dishes(payload, shared, ledgers(mail, int(np.frombuffer(payload, "<i8", 1)[0]))[1])
    p, roots = dishes.predictive(shard)
    p = np.log10(p)
    dish_keys = (dishes.word_at << 16) | dishes.contexts
    counts = np.where(dishes.place > 0, shared.word_counts[dishes.place],
                      np.bincount(dishes.word_at, dishes.counts, len(dishes.words)))
    states = range(2, SWEEPS + 1)
    backs = np.array([shared.back_off(k) for k in states])
    frequent_roots = np.array([shared.root_p(shared.root[k], k) for k in states])
    unknown = np.array([shared.root_p(np.zeros(1), k)[0] for k in states])

    def look_up(words, contexts):
        contexts = contexts.astype(np.int64)
        at = position(dishes.words, words)
        dish = np.where(at >= 0, position(dish_keys, (at << 16) | contexts), -1)
        # a frequent word is known wherever it is dealt
        place = position(shared.frequent, words) + 1
        place = np.where(shared.word_counts[place] > 0, place, 0)
        known = np.where(at >= 0, np.append(counts, 0)[at], shared.word_counts[place])
        score, rest = np.empty(len(words)), np.flatnonzero(dish < 0)
        score[dish >= 0] = p[dish[dish >= 0]]
        contexts, at, place = contexts[rest], at[rest], place[rest]
        root = np.where(place > 0, frequent_roots[:, place], np.append(roots, unknown[:, None], axis=1)[:, at])
        score[rest] = np.log10((backs[:, contexts] * root).mean(axis=0))
        return known, score

    return look_up


def after_rare(model, mail, shared: Shared, shard: int):
    """Rare contexts and words (places of frequent ones, hashes of others) -> the words' training counts, and scores."""
    roots, counts = roots_told(mail)
    rare = Rare(payload_of(model, RESTAURANTS), shared, roots)
    p, backs, roots = rare.predictive(shard)
    p = np.log10(p)
    dish_keys = (rare.context_at << 32) | rare.word_at
    counts = np.concatenate((shared.word_counts, counts))
    # a context that no training text has: the root's probabilities
    backs = np.concatenate((backs, np.ones((len(backs), 1))), axis=1)

    def look_up(contexts, words):
        word_at = words.astype(np.int64) if words.dtype == np.dtype("<u2") else position(rare.names, words) + rare.frequent
        at = position(rare.contexts, contexts)
        dish = np.where(at >= 0, position(dish_keys, (at << 32) | word_at), -1)
        score, seen = np.empty(len(contexts)), dish >= 0
        score[seen] = p[dish[seen]]
        score[~seen] = np.log10((backs[:, at[~seen]] * roots[:, word_at[~seen]]).mean(axis=0))
        return counts[word_at], score

    return look_up


def scored(told):
    """Shard side: the shard's models, then each batch's tokens looked up in them."""
    def run(key, model, table):
        shared: Shared = told.value
        shard = shard_in(model, table)
        if shard < 0:  # the documents of a batch
            return pa.table({"kind": table.column("kind"), "key": table.column("batch"),
                             "batch": table.column("batch"), "payload": table.column("payload")})
        kinds, numbers, payloads = (table.column(c) for c in ("kind", "batch", "payload"))
        kinds, numbers = kinds.to_pylist(), numbers.to_pylist()
        unit = np.log10(shared.tokens + shared.words + 1)
        found: dict[int, list] = {}
        for side, types in ((after_frequent, {AFTER: "<u2"}), (after_rare, {OFTEN: "<u2", SELDOM: "<u8"})):
            here = [i for i, k in enumerate(kinds) if k in types]
            look_up = side(model, table, shared, shard) if here else None
            for i in here:
                words, others, docs = ungrouped(unpacked(payloads[i]), "<u2", types[kinds[i]])
                found.setdefault(numbers[i], []).append((docs, *look_up(words, others)))
        out = []
        for number, parts in found.items():
            docs, known, score = (np.concatenate(x) for x in zip(*parts))
            which, back = np.unique(docs, return_inverse=True)
            out.append((1, number, number, summed(
                which, np.bincount(back, np.log10(known + 1) - unit), np.bincount(back, known > 0),
                np.bincount(back, score))))
        return table_of(out)

    return run


def gathered(tokens: int):
    """Batch side: sums over the shards for each document."""
    def run(key, table):
        kinds, payloads = table.column("kind").to_pylist(), [unpacked(p) for p in table.column("payload")]
        info = next(p for k, p in zip(kinds, payloads) if k == 0)
        n = int(np.frombuffer(info, "<i8", 1)[0])
        known_id = np.frombuffer(info, "u1", n, 8).astype(bool)
        ids = np.frombuffer(info, "<i8", n, 8 + n)
        held = np.frombuffer(info, "u1", n, 8 + 9 * n).astype(bool)
        lengths = np.frombuffer(info, "<i8", n, 8 + 10 * n)
        parts = [unsummed(info, 8 + 18 * n)] + [unsummed(p) for k, p in zip(kinds, payloads) if k]
        docs, base, known, score = (np.concatenate(x) for x in zip(*parts))
        return pa.table({
            "doc_id": pa.array(ids, mask=~known_id), "held_out": pa.array(held), "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.bincount(docs, known, n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)),
            "base_score": pa.array(np.bincount(docs, base, n)), "score": pa.array(np.bincount(docs, score, n))})

    return run


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2,
              contexts: int = CONTEXTS, told_share: int = TOLD, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    shards = shards or shards_for(shuffle_width(spark), text_bytes(docs, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       held_out(doc_id, modulus, remainder).alias("held_out"))
    frequent, tokens = frequent_words(rows, contexts)
    told = sc.broadcast(frequent)
    # bucketed by shard, so that the exchanges move the mail only
    name, path, homes = f"lm_model_{uuid.uuid4().hex}", fresh_path(spark, "lm-model"), homes_of(spark, shards)
    counts = at_home(counted(rows, told, shards), homes).repartition(shards, "home")
    (at_home(counts.groupBy("home").applyInArrow(merged, PACKET), homes).write.bucketBy(shards, "home")
     .format("parquet").option("path", path).saveAsTable(name))
    delete_at_exit(spark, path)
    try:
        model, mail, shared = spark.table(name), spark.createDataFrame([], PACKET), Shared(frequent, tokens)
        for sweeps in range(SWEEPS + 1):
            mail = exchanged(model, mail, shared, sweeps, homes)
        state = sc.broadcast(shared)
        dishes = sc.broadcast(told_dishes(model, mail, state, told_share, homes))
    finally:
        spark.sql(f"DROP TABLE {name}")
    packets = at_home(sent_tokens(rows, state, dishes, shards).unionByName(mail), homes)
    sums = model.groupBy("home").cogroup(packets.groupBy("home")).applyInArrow(scored(state), PACKET)
    return sums.groupBy("key").applyInArrow(gathered(tokens), SCORES)
