"""Filter interaction audit by truth-table survival words.

Five filters judge every document; what each order of them keeps follows from which
sets of filters a document survives.  A document becomes a 32-bit word: bit S is set
if it passes every filter of the set S.  Carry-save adders add the words of a part and
label bit by bit (three words of one weight become a sum word of that weight and a
carry word of twice it), so a task counts the survivors of all 32 sets at once.  All
120 orders are then read off 32 numbers per part and label.

Filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * A-Z characters
> 10 * code points; D any of ``#$%&*|``; E identical to the text of a smaller doc_id.

E compares SHA-256 digests: the smallest id of each digest is aggregated (map tasks
combine first) and joined back as short rows, of digests with several rows only; a
digest that a third of the rows have is split by skew handling.  Counters leave a task
as one row per part and label.

Defined cases: a null text is empty, a null language is the part ''; E fails no row
without an id, and none of the rows that repeat the smallest id; labels of a repeated
id count if any of its rows says 1; null labels and labels without a document are
ignored.  An empty table gives no parts.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged as stage

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|")] = True
#: Words that one step of the adders takes.
STEP = 1 << 16


def survival_words() -> np.ndarray:
    """Word of each set of failed filters: bit S if it fails none of S."""
    sets = np.arange(SETS)
    return ((sets[:, None] & sets[None, :]) == 0).astype(np.uint32) @ (np.uint32(1) << sets.astype(np.uint32))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set, by carry-save adders."""
    counts = np.zeros(32, np.int64)
    bits = np.arange(32, dtype=np.uint32)
    weight = 0
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third:2 * third], words[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third:]])
        counts += ((words[:, None] >> bits) & np.uint32(1)).sum(axis=0, dtype=np.int64) << weight
        words, weight = np.concatenate(carries) if carries else words[:0], weight + 1
    return counts


def failed_of_text(data: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = data.split()  # bytes split at space and 0x09-0x0D only
    chars = np.frombuffer(data, np.uint8)
    upper = int(((chars >= 65) & (chars <= 90)).sum())
    points = int(((chars & 0xC0) != 0x80).sum())
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2
            | bool(SYMBOLS[chars].any()) << 3)


def judged_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, failed (bits of A to D), sha (of the text), without the text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = source.select("doc_id", "part", F.lit(0).alias("failed"), F.lit(b"").alias("sha")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, sha = [], []
            for value in batch.column("text"):
                data = value.as_py()
                failed.append(failed_of_text(data))
                sha.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(sha, pa.binary())],
                schema.names)

    return source.mapInArrow(run, schema)


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, failed (bits of A to E), good, toxic: a row per row of ``docs``."""
    judged = stage(judged_texts(docs, doc_id, text, part), "audit-judged")
    first = stage(judged.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1").select("sha", "first"), "audit-first")
    says = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))]
    marks = stage(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(*says)
                  .filter("good OR toxic"), "audit-marks")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    told = stage(judged.join(first, "sha", "left").select("doc_id", "part", (F.col("failed") + copy).alias("failed")),
                 "audit-failed")
    return told.join(marks, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(failed: DataFrame) -> DataFrame:
    """part, label (all, good, toxic) and counts (survivors of each of the 32 sets)."""
    source = failed.select("part", (F.col("failed") + 32 * F.col("good").cast("int") + 64 * F.col("toxic").cast("int"))
                           .alias("bits"))
    names = [f"s{i}" for i in range(SETS)]
    schema = "part string, label string, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = survival_words()
        totals: dict[tuple[str, str], np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            counts = np.array(list(totals.values()), np.int64).reshape(-1, SETS)
            out = [pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.string()),
                   *[pa.array(counts[:, i]) for i in range(SETS)]]
            totals.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "label", *names])

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            own, bits = parts.indices.to_numpy(), batch.column("bits").to_numpy()
            words = table[bits & (SETS - 1)]
            for code, part in enumerate(parts.dictionary.to_pylist()):
                here = own == code
                for label, chosen in (("all", here), ("good", here & (bits & 32 > 0)), ("toxic", here & (bits & 64 > 0))):
                    mine = words[chosen]
                    for i in range(0, len(mine), STEP):
                        old = totals.get((part, label), 0)
                        totals[part, label] = old + positional_counts(mine[i:i + STEP])
            if len(totals) > 4096:
                yield rows()
        if totals:
            yield rows()

    sums = source.mapInArrow(run, schema).groupBy("part", "label").agg(*[F.sum(n).alias(n) for n in names])
    return sums.select("part", "label", F.array(*names).alias("counts"))


def orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step, set applied before, bit of the step's filter."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: every part, order and step, zeros included."""
    counted = survivors(failures(docs, labels, doc_id, text, part))
    # map values of one label each, empty if a part has none
    of = counted.groupBy("part").agg(*[F.max(F.when(F.col("label") == x, F.col("counts"))).alias(x)
                                       for x in ("all", "good", "toxic")])
    none = F.array_repeat(F.lit(0).cast("long"), SETS)
    of = stage(of.select("part", *[F.coalesce(x, none).alias(x) for x in ("all", "good", "toxic")]), "audit-counts")
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"),
                               F.lit(f).alias("own")) for o, s, b, f in orders()])
    each = of.withColumn("s", F.explode(steps)).select("*", "s.*").drop("s")
    full = F.lit(SETS - 1)

    def lost(name: str, before=None):
        before = F.col("before") if before is None else before
        return F.get(F.col(name), before) - F.get(F.col(name), before.bitwiseOR(F.col("own")))

    removed = lost("all")
    rest = full.bitwiseAND(F.bitwise_not("own"))
    told = each.select(
        "part", "filter_order", "step", "own", F.get("all", F.col("before").bitwiseOR(F.col("own"))).alias("kept"),
        removed.alias("removed"), (lost("all", F.lit(0)) - removed).alias("redundant"),
        lost("all", rest).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    totals = told.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return told.join(totals, ["part", "own"]).drop("own")
