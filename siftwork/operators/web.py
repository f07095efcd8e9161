"""Web corpus operators: score, filter, rank and summarise page texts.

Every step is a narrow projection or filter on the page rows; only the final
ranking (a global sort / top-k) and the summaries shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import count_substr, fence, md5_prefix, word_count
from ..functions.webscore import (
    web_coherence_from, web_coherence_inputs, web_quality_from, web_quality_inputs, with_repeated_terms,
)

# Fixed values that must equal the reference defaults.
MIN_PAGE_WORDS = 50
MIN_QUALITY = 6.0
MAX_PAGES = 50


def word_stats(df: DataFrame, content: str = "content") -> DataFrame:
    c = F.coalesce(F.col(content), F.lit(""))
    return df.withColumns({
        "word_count": word_count(c),
        "sentence_count": count_substr(c, ".") + 1,
        "exclamation_count": count_substr(c, "!"),
        "char_count": F.length(c),
    })


def score_pages(df: DataFrame, content: str = "content", title: str = "title",
                quality: bool = True, coherence: bool = True) -> DataFrame:
    """Adds word_count plus quality_score and/or coherence_score (with
    repeated_terms).

    The per-row counters (regex scans of the whole text) are computed once in
    one projection behind a fence; the scores are arithmetic on them, so a
    later filter on a score does not re-scan the text.  A fence also stops
    column pruning, so only the requested scores are staged.
    """
    staged = with_repeated_terms(df, content) if coherence else df
    inputs = {**web_quality_inputs(F.col(content), F.col(title))} if quality else {"_qwc": word_count(F.col(content))}
    if coherence:
        inputs.update(web_coherence_inputs(F.col(content)))
    staged = fence(staged.withColumns(inputs))
    outs = {"word_count": F.col("_qwc")}
    if quality:
        outs["quality_score"] = web_quality_from()
    if coherence:
        outs["coherence_score"] = web_coherence_from(F.col("repeated_terms"))
    out = staged.withColumns(outs)
    return out.drop(*[c for c in staged.columns if c.startswith("_q") or c.startswith("_c")])


def add_coherence(df: DataFrame, content: str = "content") -> DataFrame:
    """repeated_terms + coherence_score for rows that are already filtered
    (coherence never decides a filter, so it is computed for survivors only)."""
    staged = with_repeated_terms(df, content).withColumns(web_coherence_inputs(F.col(content)))
    out = staged.withColumn("coherence_score", web_coherence_from(F.col("repeated_terms")))
    return out.drop(*[c for c in staged.columns if c.startswith("_c")])


def keep_quality_pages(scored: DataFrame, min_words: int = MIN_PAGE_WORDS, min_quality: float = MIN_QUALITY) -> DataFrame:
    """F-1 (non-empty, >= 50 words) then F-3 (quality >= min_quality)."""
    return scored.where((F.col("word_count") >= min_words) & (F.col("quality_score") >= F.lit(min_quality)))


def rank_pages(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """W-1: quality descending, key ascending as unique tie-break; optional top-k."""
    ordered = df.orderBy(F.col("quality_score").desc(), F.col(key).asc())
    # fenced top-k: later projections are not pushed below the limit, so the
    # plan stays a TakeOrderedAndProject (k rows) instead of a full sort
    return fence(ordered.limit(k)) if k is not None else ordered


def source_type(url: str = "url") -> "F.Column":
    """P-4: source class from the URL authority (netloc, incl. user info and port)."""
    u = F.col(url)
    netloc = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    lu = F.lower(u)
    return (
        F.when(netloc.contains("stackoverflow.com"), "stackoverflow")
        .when(netloc.contains("github.com"), "github")
        .when(netloc.contains("medium.com") | netloc.contains("dev.to"), "blog")
        .when(netloc.contains("docs.") | lu.contains("documentation"), "documentation")
        .when(lu.contains("tutorial") | lu.contains("guide"), "tutorial")
        .otherwise("general")
    )


def retrieval_records(scored: DataFrame, url: str = "url") -> DataFrame:
    """P-6 + P-32 + P-33: id = first 12 hex of md5(url), nested metadata with the
    ingestion time (never compared)."""
    return scored.select(
        md5_prefix(F.col(url)).alias("id"),
        F.col(url).alias("url"),
        F.col("title"),
        F.col("content"),
        F.struct(
            F.col("source_type"),
            F.col("quality_score"),
            F.col("coherence_score"),
            F.col("word_count"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        ).alias("metadata"),
    )


def retrieval_stat_columns() -> list:
    """A-7: dataset statistics (null averages on an empty set)."""
    return [
        F.count(F.lit(1)).alias("total_documents"),
        F.avg("metadata.quality_score").alias("avg_quality_score"),
        F.avg("metadata.coherence_score").alias("avg_coherence_score"),
        F.coalesce(F.sum("metadata.word_count"), F.lit(0)).cast("long").alias("total_words"),
    ]


def retrieval_stats(records: DataFrame) -> DataFrame:
    """A-7 of stored records: one row."""
    return records.agg(*retrieval_stat_columns())


def source_breakdown(rows: DataFrame, column: str = "metadata.source_type", count: str = "documents") -> DataFrame:
    """A-8: rows per source type (partial aggregation before the shuffle)."""
    return rows.groupBy(F.col(column).alias("source_type")).agg(F.count(F.lit(1)).alias(count))


def url_frontier(seeds: DataFrame, found: DataFrame, seen: DataFrame, url: str = "url",
                 max_pages: int | None = None) -> DataFrame:
    """SET-2 + W-10 + J-4: seed URLs then searched URLs (bag union); a URL is handled
    once (first sighting) and never if it was already scraped (anti join).  With
    ``max_pages`` only the first so many in (origin, position) order are candidates."""
    cand = seeds.select(F.col(url).alias("url"), F.lit(0).alias("origin"), F.col("pos")).unionByName(
        found.select(F.col(url).alias("url"), F.lit(1).alias("origin"), F.col("pos"))
    )
    if max_pages is not None:
        cand = cand.orderBy("origin", "pos").limit(max_pages)  # top-k: at most max_pages rows after this
    first = cand.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("url").orderBy("origin", "pos"))
    ).where(F.col("_rn") == 1).drop("_rn")
    return first.join(seen.select(F.col(url).alias("url")).distinct(), "url", "left_anti")
