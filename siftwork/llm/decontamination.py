"""Benchmark decontamination by a broadcast hash set of test n-grams, Spark expressions only.

Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII characters.  A
benchmark item gives its windows of ``size`` consecutive words, or one window of all
its words if it has fewer.

1. Distinct windows become rows of fixed size: a 64-bit hash, a length, a SHA-256 of
   the words and one of the list of items that have the window.
2. They are broadcast ``BLOCK`` at a time, so what is told is bounded whatever the
   benchmark holds; one block (nearly always) reads the documents once, and more read
   a staged table of their words once each.
3. A document's windows are hashed in its row, exploded against the set in the same
   stage, and verified by their SHA-256 there: only true hits leave the task.
4. Hits are merged to spans of words per document.  Documents with the same list of
   window classes share one lookup of item ids, so a passage that a third of the
   documents quote is expanded to its items once.

Defined cases: a null text has no words; an item without words has no window; a null
item id hits like any other but is in no list of items; rows of one item id are one
item; repeated documents and null ids get a row each; an empty benchmark leaves all
clean, an empty documents table gives an empty result.  Other columns, whatever their
names, are carried by ``decontaminate`` and ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fence
from ..session import staged as stage
from .common import lower_ascii, text_or_empty

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands before a word and the word, or what is left after the last.
PIECES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+\z"
SIZE = 10
#: Windows broadcast at a time, about 100 bytes each.
BLOCK = 1 << 18
NO_ITEMS = sha256(b"").hexdigest()


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0))


def digest(window: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(window, " ").cast("binary"), 256))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """h, len, sha, items, class: one row per distinct window; items are sorted ids."""
    cut = benchmark.select(F.col(item_id).cast("string").alias("item"), words(text_or_empty(text)).alias("words")).filter(
        F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(size)))
    each = cut.select("item", "len", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias(
        "at")).select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("w"))
    return each.select("item", "len", F.xxhash64("w").alias("h"), digest(F.col("w")).alias("sha")).groupBy(
        "h", "len", "sha").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn(
        "class", F.unhex(F.sha2(F.to_json("items").cast("binary"), 256)))


def hashes(found: Column, many: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), many), lambda i: F.xxhash64(F.slice(found, i, size)))


def scan(cut: DataFrame, block: DataFrame, sizes: list[int]) -> DataFrame:
    """Verified hits (rid, doc_id, n_words, pos, len, class) of documents (rid, doc_id,
    words) against one broadcast block of windows.  Each document's array of hashes
    starts with a zero that meets the block's row of length 0, if it has one."""
    n = F.size("words")
    hashed = [F.array(F.lit(0).cast("long"))]
    place = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("len"))
    before = F.lit(1)
    for s in sizes:
        many = F.greatest(n - s + 1, F.lit(0))
        hashed.append(F.when(n >= s, hashes(F.col("words"), many, s)).otherwise(F.array().cast("array<bigint>")))
        place = F.when(F.col("i") >= before, F.struct((F.col("i") - before + 1).alias("pos"), F.lit(s).alias("len"))
                       ).otherwise(place)
        before = before + many
    # hashed before the explode, which then is part of the join's generated code; an outer
    # one, as a filter on the size of the array would compute it twice
    seen = cut.withColumn("hashed", F.concat(*hashed)).select(
        "rid", "doc_id", "words", F.posexplode_outer("hashed").alias("i", "h"))
    # at most BLOCK rows of fixed size; the fence keeps the join to one long key
    met = fence(seen.join(F.broadcast(block.withColumnRenamed("len", "of_len")), "h").select(
        "rid", "doc_id", n.cast("long").alias("n_words"), place.alias("at"), "of_len", "sha", "class",
        digest(F.slice("words", place["pos"], place["len"])).alias("own")))
    return met.filter("at.len = of_len AND sha = own").select(
        "rid", "doc_id", "n_words", F.col("at.pos").alias("pos"), F.col("at.len").alias("len"), "class")


def found(cut: DataFrame, grams: DataFrame, block: int = BLOCK) -> DataFrame:
    """Staged rows of ``scan``: one of length 0 per document, and one per hit."""
    told = grams.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()  # at most SIZE rows
    sizes, blocks = sorted(r["len"] for r in told), -(-sum(r["n"] for r in told) // block) or 1
    if blocks > 1:
        cut = stage(cut, "decon-words")
    plain = grams.select("h", "len", "sha", "class")
    own = grams.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"),
                                             digest(F.array().cast("array<string>")).alias("sha"),
                                             F.lit(None).cast("binary").alias("class"))
    parts = [plain if blocks == 1 else plain.filter(F.pmod("h", F.lit(blocks)) == b) for b in range(blocks)]
    return stage(reduce(DataFrame.unionByName, [scan(cut, p.unionByName(own) if b == 0 else p, sizes)
                                                for b, p in enumerate(parts)]), "decon-found")


def spans(hits: DataFrame) -> DataFrame:
    """rid, n_hit, spans (start, end) of words counted from 0, and the sorted window classes."""
    order = Window.partitionBy("rid").orderBy("pos", "len")
    ends = F.max(F.col("pos") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (ends.isNull() | (F.col("pos") > ends)).cast("int")
    runs = hits.withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("rid", "run").agg((F.min("pos") - 1).alias("start"),
                                            (F.max(F.col("pos") + F.col("len")) - 1).alias("end"),
                                            F.collect_set("class").alias("classes"))
    return merged.groupBy("rid").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))


def item_lists(classed: DataFrame, grams: DataFrame) -> DataFrame:
    """classes, n_items, items_sha256 of each distinct list of window classes."""
    lists = classed.select("classes").distinct()
    items = grams.select("class", "items").dropDuplicates(["class"])
    each = lists.select("classes", F.explode("classes").alias("class")).join(items, "class").select(
        "classes", F.explode("items").alias("item"))
    return each.groupBy("classes").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        "classes", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: a row per row of ``docs``."""
    cut = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
                      words(text_or_empty(text)).alias("words"))
    grams = stage(windows(benchmark, item_id, item_text, size), "decon-windows")
    rows = found(cut, grams, block)
    hit = stage(spans(rows.filter("len > 0")), "decon-spans")
    listed = hit.join(item_lists(hit, grams), "classes", "left").select("rid", "n_hit", "spans", "n_items", "items_sha256")
    return rows.filter("len = 0").select("rid", "doc_id", "n_words").join(listed, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), "spans")


def without(text: Column, cuts: Column) -> Column:
    """``text`` without the words of the spans and what stands before each of them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    kept = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.array_join(F.slice(
        pieces, F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get(cuts, k)["start"], F.size(pieces)) - F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0))), ""))
    return F.array_join(kept, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` without the spans that benchmark items hold (``remove="spans"``), or
    without the documents that have one (``remove="documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    rows = stage(docs.select(F.struct("*").alias("row")).select(
        F.monotonically_increasing_id().alias("rid"), "row"), "decon-rows")
    whole = text_or_empty(F.col("row")[text])
    cut = rows.select("rid", F.col("row")[doc_id].alias("doc_id"), words(whole).alias("words"))
    grams = stage(windows(benchmark, item_id, item_text, size), "decon-windows")
    hit = spans(found(cut, grams).filter("len > 0"))
    if remove == "documents":
        return rows.join(hit, "rid", "left_anti").select("row.*")
    joined = rows.join(hit.select("rid", "spans"), "rid", "left")
    new = F.when(F.col("spans").isNull(), F.col("row")[text]).otherwise(without(whole, F.col("spans")))
    return joined.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
