"""Mixing sources to target weights by systematic sampling, in Spark only.

Weights 1, 2, 3, 1, ... go to the sources by code point, null last.  The total size
is shared by weight; a target stops at ``max_repeat`` times its source's size, and
the excess is shared again by weight.  In order of ``size / weight`` the sources that
stop come first, so one running sum finds the level at which all others share.

Within a source every document expects ``rate = target / size`` copies.  Documents
stand in order of size by octaves (inside by hash, then id), the expectations are summed up, one
random offset is added, and a document is emitted once for each integer that its
stretch of the sum crosses: floor(rate) or one more, hence never above
``max_repeat``.  As neighbours are of like size, the words taken stay close to the
target.  The offset is one random number of the seed and the source plus the
multiple of 1/``OFFSETS`` that brings the words closest to the target.

The running sums are those of :func:`siftwork.operators.running.ranked`: rows are dealt
by ranges, so a source that holds a third of all rows is spread over many tasks.

Defined cases: null text has size 0; null source is a source of its own; a source
without words has target 0, and its documents rate 0; repeated rows are documents
of their own.  Other columns, whatever their names, are ignored (``mixed_documents`` carries
them).  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import ranked
from ..session import staged as stage
from .common import n_words, text_or_empty, whole_rows

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
OFFSETS = 64


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size -> adds weight and target."""
    placed = ranked(sources, [F.col("source").asc_nulls_last()], {"_one": F.lit(1)})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stage(placed.withColumn("weight", F.get(cycle, ((F.col("_one_cum") - 1) % len(weights)).cast("int")))
                    .drop("_one", "_one_cum"), "mix-weights")
    cap = F.col("source_size") * max_repeat
    whole = weighed.agg(F.sum("source_size").cast("double").alias("all_size"), F.sum("weight").alias("all_weight"))
    order = [(cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    summed = ranked(weighed, order, {"_cap": cap, "_w": F.col("weight")}).crossJoin(F.broadcast(whole))
    # the level if all sources before this one stop
    left_size = F.col("all_size") - (F.col("_cap_cum") - F.col("_cap"))
    left_weight = F.col("all_weight") - (F.col("_w_cum") - F.col("_w"))
    levelled = stage(summed.withColumn("_level", left_size / left_weight), "mix-levels")
    # taking out a source that stops raises the level, taking out another lowers it
    level = levelled.agg(F.max("_level").alias("level"))
    target = F.least(F.col("_cap").cast("double"), F.col("level") * F.col("weight"))
    return levelled.crossJoin(F.broadcast(level)).select("source", "source_size", "weight", target.alias("target"))


def unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def copies(rank: Column, rate: Column, offset: Column) -> Column:
    return F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 20) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken: a row per row of ``docs``."""
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                              n_words(text_or_empty(text)).alias("size"),
                              F.xxhash64(text).alias("text_key")), "mix-sizes")
    per_source = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                   F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    plan = targets(per_source, weights, max_repeat).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"),
                                                         F.lit(float(max_repeat)))).otherwise(0.0))
    # rank within the source: the rank among all rows less the rows of the sources before
    octave = F.floor(F.log2(F.col("size") + 1))
    in_order = [F.col("source").asc_nulls_last(), octave.asc(), F.xxhash64(F.lit(seed), "doc_id").asc(),
                F.col("doc_id").asc()]
    before = ranked(per_source, [F.col("source").asc_nulls_last()], {"_n": F.col("n_docs")}).select(
        F.col("source").alias("_s"), (F.col("_n_cum") - F.col("n_docs")).alias("before"))
    plan = stage(plan.join(before, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-plan")
    placed = ranked(sized, in_order, {"_one": F.lit(1)}).drop("_one")
    # the plan has one row per source: a hot source is split by skew handling
    rows = stage(placed.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                 .withColumn("rank", F.col("_one_cum") - F.col("before")).drop("_s", "_one_cum", "before"), "mix-rows")
    first = unit(seed, F.col("source")) / OFFSETS
    tried = rows.groupBy("source").agg(
        F.first("target").alias("t"),
        *[F.sum(copies(F.col("rank"), F.col("rate"), first + j / OFFSETS) * F.col("size")).alias(f"w{j}")
          for j in range(OFFSETS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("t")).alias("off"), F.lit(j).alias("j"))
                                    for j in range(OFFSETS)]))["j"]
    chosen = stage(tried.select(F.col("source").alias("_s"), (first + nearest / OFFSETS).alias("offset")), "mix-offsets")
    done = rows.join(chosen, F.col("source").eqNullSafe(F.col("_s")))
    n = copies(F.col("rank"), F.col("rate"), F.col("offset")).cast("long")
    return done.select("doc_id", "size", "source", "source_size", "target",
                       (n * F.col("size")).alias("taken"), n.alias("copies"), "text_key")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    **params) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Rows equal in id,
    source and text are taken together: one of them, as often as all of them."""
    taken = mix(docs, doc_id, text, source, **params).groupBy("doc_id", "source", "text_key").agg(
        F.sum("copies").alias("times"), F.count(F.lit(1)).alias("n_rows")).filter("times > 0")
    taken = stage(taken, "mix-taken")
    keyed = whole_rows(docs, id=F.col(doc_id), of=F.col(source), key=F.xxhash64(text))
    joined = keyed.join(taken, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source"))
                        & (F.col("key") == F.col("text_key")))
    if not taken.filter("n_rows > 1").isEmpty():
        joined = joined.filter("n_rows = 1").unionByName(
            joined.filter("n_rows > 1").dropDuplicates(["id", "of", "key"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
