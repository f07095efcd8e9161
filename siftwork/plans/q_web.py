"""Queries over page texts (pipeline C scorers on the documents table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import web
from ..operators.running import ranked
from ..session import staged as stage
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from .registry import DWORD, oracle, register

_KW = ["react", "javascript", "python", "api", "component", "function", "method"]
_KW_SQL = " + ".join(f"contains(lc, '{k}')::INT" for k in _KW)

_QUALITY_SQL = f"""
b AS (
  SELECT doc_id, title, content, lower(content) AS lc,
    len(regexp_extract_all(content, '{DWORD}')) AS wc,
    len(regexp_extract_all(replace(content, '.', ' '), '{DWORD}')) AS sw,
    length(content) - length(replace(content, '.', '')) AS dots,
    length(content) - length(replace(content, '!', '')) AS bangs
  FROM fx_web_docs),
q AS (
  SELECT doc_id, wc, dots, content, lc, least(10.0, greatest(0.0,
      CAST(5.0 AS DOUBLE)
      + CASE WHEN wc BETWEEN 100 AND 5000 THEN 1.0 WHEN wc < 100 THEN -2.0 ELSE 0.0 END
      + CASE WHEN title IS NOT NULL AND length(title) > 10 THEN 0.5 ELSE 0.0 END
      + CASE WHEN contains(content, '```') OR contains(content, '<code>') OR contains(lc, 'function') THEN 1.0 ELSE 0.0 END
      + least(({_KW_SQL}) * CAST(0.3 AS DOUBLE), 1.5)
      + CASE WHEN sw / (dots + 1) BETWEEN 10 AND 25 THEN 0.5 ELSE 0.0 END
      + CASE WHEN bangs > wc * CAST(0.05 AS DOUBLE) THEN -1.0 ELSE 0.0 END)) AS quality
  FROM b)
"""

_COHERENCE_SQL = f"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(content), '{DWORD}')) AS tok FROM fx_web_docs),
freq AS (SELECT doc_id, tok FROM toks WHERE length(tok) > 4 GROUP BY doc_id, tok HAVING count(*) >= 3),
rep AS (SELECT doc_id, count(*) AS n FROM freq GROUP BY doc_id),
c AS (
  SELECT d.doc_id, coalesce(rep.n, 0) AS repeated_terms,
    least(10.0, greatest(0.0, CAST(5.0 AS DOUBLE)
      + CASE WHEN len(list_filter(string_split(d.content, chr(10) || chr(10)),
                                  lambda p: regexp_matches(p, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]'))) >= 2 THEN 1.0 ELSE 0.0 END
      + CASE WHEN length(d.content) - length(replace(d.content, '.', '')) >= 3
             THEN least(coalesce(rep.n, 0) * CAST(0.2 AS DOUBLE), 1.0) ELSE 0.0 END)) AS coherence
  FROM fx_web_docs d LEFT JOIN rep ON rep.doc_id = d.doc_id)
"""


def scored_docs(spark, sf_dir, quality=True, coherence=True):
    return web.score_pages(fixture(spark, sf_dir, "fx_web_docs"), content="content", title="title",
                           quality=quality, coherence=coherence)


@register("web_word_stats", oracle([], f"""
SELECT doc_id,
  CAST(len(regexp_extract_all(text, '{DWORD}')) AS INTEGER) AS word_count,
  CAST(length(text) - length(replace(text, '.', '')) + 1 AS INTEGER) AS sentence_count,
  CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS exclamation_count,
  CAST(length(text) AS INTEGER) AS char_count
FROM documents"""))
def web_word_stats(spark, sf_dir):
    """P-1: word, sentence, exclamation and character counts per document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return web.word_stats(docs).select("doc_id", "word_count", "sentence_count", "exclamation_count", "char_count")


@register("web_quality", oracle(["fx_web_docs"], "WITH " + _QUALITY_SQL + """
SELECT doc_id, CAST(wc AS INTEGER) AS word_count, round(quality, 6) AS quality_score FROM q"""))
def web_quality(spark, sf_dir):
    """P-18: page quality score (title = first line) per document."""
    return scored_docs(spark, sf_dir, coherence=False).select(
        "doc_id", "word_count", F.round("quality_score", 6).alias("quality_score"))


@register("web_coherence", oracle(["fx_web_docs"], "WITH " + _COHERENCE_SQL + """
SELECT doc_id, CAST(repeated_terms AS INTEGER) AS repeated_terms, round(coherence, 6) AS coherence_score FROM c"""))
def web_coherence(spark, sf_dir):
    """P-19 + A-15: coherence score and repeated-term count per document."""
    return scored_docs(spark, sf_dir, quality=False).select(
        "doc_id", "repeated_terms", F.round("coherence_score", 6).alias("coherence_score"))


@register("web_filter_topk", oracle(["fx_web_docs"], "WITH " + _QUALITY_SQL + "," + _COHERENCE_SQL + """
SELECT q.doc_id, CAST(q.wc AS INTEGER) AS word_count, round(q.quality, 6) AS quality_score,
       round(c.coherence, 6) AS coherence_score
FROM q JOIN c ON c.doc_id = q.doc_id
WHERE q.wc >= 50 AND q.quality >= 6.0
ORDER BY q.quality DESC, q.doc_id
LIMIT 50"""))
def web_filter_topk(spark, sf_dir):
    # the ranking uses quality only: take the top k first, score coherence for k rows
    """F-1 + F-3 + W-1 + W-10: documents above the word and quality floors, top 50 by quality."""
    kept = web.keep_quality_pages(scored_docs(spark, sf_dir, coherence=False))
    top = web.add_coherence(web.rank_pages(kept, "doc_id", k=web.MAX_PAGES))
    return top.select(
        "doc_id", "word_count", F.round("quality_score", 6).alias("quality_score"),
        F.round("coherence_score", 6).alias("coherence_score"))


@register("web_filter_ranked", oracle(["fx_web_docs"], "WITH " + _QUALITY_SQL + """
SELECT doc_id, round(quality, 6) AS quality_score, row_number() OVER (ORDER BY quality DESC, doc_id) AS place
FROM q WHERE wc >= 50 AND quality >= 6.0"""))
def web_filter_ranked(spark, sf_dir):
    """F-1 + F-3 + W-1: the place of every document above the floors, by quality."""
    kept = web.keep_quality_pages(scored_docs(spark, sf_dir, coherence=False)).select("doc_id", "quality_score")
    # written first: the ranges are drawn from a sample, which would score every text again
    placed = ranked(stage(kept, "scored"), [F.col("quality_score").desc(), F.col("doc_id").asc()], {"one": F.lit(1)})
    return placed.select("doc_id", F.round("quality_score", 6).alias("quality_score"),
                         F.col("one_cum").cast("long").alias("place"))
