"""Exact dedup by content-defined chunk recipes, as Spark expressions only.

A text (A-Z lower-cased, nothing else changed) is cut where its content says so:
a chunk has at least ``MIN_CHUNK`` code points and ends after the next sentence
end or newline, at ``MAX_CHUNK`` at the latest.  Equal texts have equal chunks,
and one changed sentence leaves the other chunks as they were.

1. Each distinct chunk is moved once: map tasks drop repeats before the shuffle.
   A fingerprint that only one content has is that content's verified identifier.
2. Contents that share a fingerprint (64 bits, so close to never) are told apart
   by a rank among themselves; those documents alone are cut again.
3. A document is now a short list of identifiers.  Lists are grouped and compared
   element by element; whole texts are not moved at all.

Defined cases: a null text equals the empty text; of several rows with the largest
doc_id of a group one stays; a row without doc_id stays only if its group has no
other; a group of such rows has a null keep_id.  Other columns, whatever their names, are
ignored (``keep_one`` carries them), and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged as stage
from .common import lower_ascii, text_or_empty, whole_rows

MIN_CHUNK, MAX_CHUNK = 512, 8192


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    pattern = rf"(?s).{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, doc_id: str, text: str, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """One row per document: rid, doc_id, text_sha256 and its ordered identifiers."""
    norm = lower_ascii(text_or_empty(text))
    cut = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    prints = stage(cut.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), fingerprint).alias("prints")), "dedup-prints")
    pieces = cut.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(
        fingerprint(F.col("chunk")).alias("fp"), "chunk")
    contents = pieces.groupBy("fp", "chunk").agg(F.lit(1).alias("one"))
    shared = stage(contents.groupBy("fp").agg(F.count("one").alias("n")).filter("n > 1"), "dedup-shared")
    if shared.isEmpty():
        return prints.withColumn("recipe", F.transform("prints", lambda p: F.struct(p.alias("fp"), F.lit(0).alias("k"))))
    return separate(docs, text, fingerprint, prints, shared)


def separate(docs: DataFrame, text: str, fingerprint: Callable[[Column], Column], prints: DataFrame,
             shared: DataFrame) -> DataFrame:
    """Identifiers where a fingerprint stands for several contents: the rank of the
    content among those of its fingerprint is added."""
    norm = lower_ascii(text_or_empty(text))
    placed = (docs.select(F.sha2(norm, 256).alias("text_sha256"), F.posexplode(chunks(norm)).alias("pos", "chunk"))
              .withColumn("fp", fingerprint(F.col("chunk"))))
    touched = placed.join(shared.select("fp"), "fp", "left_semi").select("text_sha256").distinct()
    again = placed.join(touched, "text_sha256", "left_semi").dropDuplicates(["text_sha256", "pos"])
    contents = again.join(shared.select("fp"), "fp", "left_semi").select("fp", "chunk").distinct()
    from pyspark.sql import Window

    ranked = contents.withColumn("k", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")))
    told = (again.join(ranked, ["fp", "chunk"], "left")
            .groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct(
                "pos", "fp", F.coalesce("k", F.lit(0)).alias("k")))).alias("ordered")))
    mended = told.select("text_sha256", F.transform("ordered", lambda o: F.struct(o["fp"], o["k"])).alias("mended"))
    plain = F.transform("prints", lambda p: F.struct(p.alias("fp"), F.lit(0).alias("k")))
    return prints.join(mended, "text_sha256", "left").withColumn("recipe", F.coalesce("mended", plain)).drop("mended")


def xx(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                fingerprint: Callable[[Column], Column] = xx) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    rows = recipes(docs, doc_id, text, fingerprint).select(
        "rid", "doc_id", "text_sha256", "recipe", F.xxhash64("recipe").alias("rkey"))
    groups = stage(rows.groupBy("rkey", "recipe").agg(
        F.max(F.struct("doc_id", "rid")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"), "dedup-groups")
    # both sides come from files, so a recipe that a third of the rows have is split by skew handling
    joined = rows.join(groups, ["rkey", "recipe"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("last.rid"))).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, doc_id, text).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    told = whole_rows(docs, id=F.col(doc_id), sha=F.sha2(lower_ascii(text_or_empty(text)), 256))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    stays = told.join(kept, same, "left_semi")
    # rows repeated with one id: one of them
    often = (stays.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.col("id").alias("kept_id"), F.col("sha").alias("kept_sha")))
    often = stage(often, "dedup-repeated")
    if often.isEmpty():
        return stays.select("row.*")
    return (stays.join(often, same, "left_anti")
            .unionByName(stays.join(often, same, "left_semi").dropDuplicates(["id", "sha"])).select("row.*"))
