"""Queries over raw pages (pipeline C: extract -> clean -> score -> records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import web
from ..operators.pages import extract_pages
from ..session import fresh_path
from ..sources.fixtures import fixture
from ..sources.io import write_observed
from ..sources.tables import read_table
from .registry import DWORD, DWS, ORACLES, oracle, register
from .q_web import _KW_SQL

# ---------------------------------------------------------------- oracle side
# DuckDB (RE2) formulation of the extraction.  RE2 has no back-references, so
# regions are read per tag name; the driver pages use <article>/<main>/<body>.


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{DWS}+|{DWS}+$', '', 'g')"


def _dec(x: str) -> str:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
                    ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
                    ("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#39", "''"), ("&nbsp", " "),
                    ("&copy", "©"), ("&reg", "®"), ("&middot", "·")]:
        x = f"replace({x}, '{ent}', '{ch}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_TAG = "<[a-zA-Z/!?][^>]*>"
_CODE = r"(?is)<pre\b[^>]*>.*?</pre\s*>|<code\b[^>]*>.*?</code\s*>"


def extraction_ctes(src: str) -> str:
    """CTEs ending in ``px(page_id, url, title, content)`` for table ``src``."""
    rm = "html"
    for t in ("script", "style"):
        rm = f"regexp_replace({rm}, '(?is)<{t}\\b[^>]*>.*?(?:</{t}\\s*>|\\z)', ' ', 'g')"
    rm = f"regexp_replace({rm}, '(?s)<!--.*?-->', ' ', 'g')"
    for t in ("nav", "header", "footer", "aside", "iframe", "noscript"):
        rm = f"regexp_replace({rm}, '(?is)<{t}\\b[^>]*>.*?(?:</{t}\\s*>|\\z)', ' ', 'g')"

    def inner(tag, h):
        raw = f"regexp_extract({h}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
        return _strip(_dec(f"regexp_replace({raw}, '{_TAG}', '', 'g')"))

    def region(tag, h):
        return f"regexp_extract({h}, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|\\z)', 1)"

    p14 = "t"
    p14 = f"regexp_replace({p14}, '{DWS}+', ' ', 'g')"
    p14 = f"regexp_replace({p14}, '{DWS}*([.!?]){DWS}*', '\\1 ', 'g')"
    p14 = f"regexp_replace({p14}, '{DWS}*([,;:]){DWS}*', '\\1 ', 'g')"
    p14 = f"regexp_replace({p14}, '{DWS}*\\|{DWS}*', ' | ', 'g')"
    p14 = f"regexp_replace({p14}, '{DWS}*>{DWS}*', ' > ', 'g')"
    fence = "chr(10) || chr(10) || '```' || chr(10) || blocks[i - 1] || chr(10) || '```' || chr(10) || chr(10) || p"
    return f"""
x1 AS (SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS hc, {rm} AS s FROM {src}),
x2 AS (SELECT page_id, url,
    CASE WHEN regexp_matches(hc, '(?i)<title\\b') THEN {inner('title', 'hc')}
         WHEN regexp_matches(hc, '(?i)<h1\\b') THEN {inner('h1', 'hc')} ELSE '' END AS title,
    CASE WHEN regexp_matches(s, '(?i)<main\\b') THEN {region('main', 's')}
         WHEN regexp_matches(s, '(?i)<article\\b') THEN {region('article', 's')}
         WHEN regexp_matches(s, '(?i)<body\\b') THEN {region('body', 's')} ELSE s END AS r
  FROM x1),
x3 AS (SELECT page_id, url, title,
    list_transform(regexp_extract_all(r, '{_CODE}', 0),
      lambda b: regexp_replace({_strip(_dec(f"regexp_replace(b, '{_TAG}', '', 'g')"))}, '\\n{DWS}*\\n', chr(10), 'g')) AS blocks,
    {_dec(f"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(r, '{_CODE}', ' ' || chr(1) || ' ', 'g'), chr(1)), lambda p, i: CASE WHEN i = 1 THEN p ELSE ' __CODE_BLOCK_' || CAST(i - 2 AS VARCHAR) || '__ ' || p END), ''), '{_TAG}', ' ', 'g')")} AS t
  FROM x2),
x4 AS (SELECT page_id, url, title, blocks, string_split_regex({_strip(p14)}, '{DWS}+') AS words FROM x3),
x5 AS (SELECT page_id, url, title, blocks,
    {_strip(f"regexp_replace(array_to_string(list_filter(words, lambda w, i: i = 1 OR length(w) <= 3 OR lower(w) <> lower(words[i - 1])), ' '), '{DWS}+', ' ', 'g')")} AS cleaned
  FROM x4),
px AS (SELECT page_id, url, title,
    CASE WHEN len(blocks) = 0 THEN cleaned ELSE
      {_strip(f"array_to_string(list_transform(string_split_regex(cleaned, '__CODE_BLOCK_[0-9]+__'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {fence} END), '')")}
    END AS content
  FROM x5)
"""


def scoring_ctes(src: str = "px") -> str:
    """CTEs ending in ``sc(page_id, url, title, content, word_count, quality, coherence, source_type)``."""
    return f"""
b AS (
  SELECT page_id, url, title, content, lower(content) AS lc,
    len(regexp_extract_all(content, '{DWORD}')) AS wc,
    len(regexp_extract_all(replace(content, '.', ' '), '{DWORD}')) AS sw,
    length(content) - length(replace(content, '.', '')) AS dots,
    length(content) - length(replace(content, '!', '')) AS bangs
  FROM {src}),
toks AS (SELECT page_id, unnest(regexp_extract_all(lc, '{DWORD}')) AS tok FROM b),
freq AS (SELECT page_id, tok FROM toks WHERE length(tok) > 4 GROUP BY page_id, tok HAVING count(*) >= 3),
rep AS (SELECT page_id, count(*) AS n FROM freq GROUP BY page_id),
sc AS (
  SELECT b.page_id, b.url, b.title, b.content, CAST(b.wc AS INTEGER) AS word_count,
    least(10.0, greatest(0.0,
      CAST(5.0 AS DOUBLE)
      + CASE WHEN wc BETWEEN 100 AND 5000 THEN 1.0 WHEN wc < 100 THEN -2.0 ELSE 0.0 END
      + CASE WHEN title IS NOT NULL AND length(title) > 10 THEN 0.5 ELSE 0.0 END
      + CASE WHEN contains(content, '```') OR contains(content, '<code>') OR contains(lc, 'function') THEN 1.0 ELSE 0.0 END
      + least(({_KW_SQL}) * CAST(0.3 AS DOUBLE), 1.5)
      + CASE WHEN sw / (dots + 1) BETWEEN 10 AND 25 THEN 0.5 ELSE 0.0 END
      + CASE WHEN bangs > wc * CAST(0.05 AS DOUBLE) THEN -1.0 ELSE 0.0 END)) AS quality,
    least(10.0, greatest(0.0, CAST(5.0 AS DOUBLE)
      + CASE WHEN len(list_filter(string_split(b.content, chr(10) || chr(10)),
                                  lambda p: regexp_matches(p, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]'))) >= 2 THEN 1.0 ELSE 0.0 END
      + CASE WHEN dots >= 3 THEN least(coalesce(rep.n, 0) * CAST(0.2 AS DOUBLE), 1.0) ELSE 0.0 END)) AS coherence,
    {_source_type_sql('b.url')} AS source_type
  FROM b LEFT JOIN rep ON rep.page_id = b.page_id)
"""


def _source_type_sql(u: str) -> str:
    net = f"lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1))"
    return (f"CASE WHEN contains({net}, 'stackoverflow.com') THEN 'stackoverflow' "
            f"WHEN contains({net}, 'github.com') THEN 'github' "
            f"WHEN contains({net}, 'medium.com') OR contains({net}, 'dev.to') THEN 'blog' "
            f"WHEN contains({net}, 'docs.') OR contains(lower({u}), 'documentation') THEN 'documentation' "
            f"WHEN contains(lower({u}), 'tutorial') OR contains(lower({u}), 'guide') THEN 'tutorial' "
            f"ELSE 'general' END")


# ----------------------------------------------------------------- spark side

def quality_pages(spark, sf_dir, src="pages"):
    """Extracted, quality-scored pages that pass F-1 / F-3."""
    pages = read_table(spark, sf_dir, "pages") if src == "pages" else fixture(spark, sf_dir, src)
    x = extract_pages(pages.select("page_id", "url", "html"))
    return web.keep_quality_pages(web.score_pages(x, coherence=False))


def scored_pages(spark, sf_dir, src="pages"):
    """Pages that pass F-1 / F-3 with coherence and source type."""
    return web.add_coherence(quality_pages(spark, sf_dir, src)).withColumn("source_type", web.source_type("url"))


@register("page_title_main", oracle([], "WITH " + extraction_ctes("pages") + """
SELECT page_id, title, md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS content_chars FROM px"""))
def page_title_main(spark, sf_dir):
    """S-5 + P-11 + P-12: title and main text (hash, length) of each raw page."""
    x = extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return x.select("page_id", "title", F.md5("content").alias("content_md5"),
                    F.length("content").alias("content_chars"))


@register("page_clean_text", oracle([], "WITH " + extraction_ctes("pages") + f"""
SELECT page_id, content, CAST(len(regexp_extract_all(content, '{DWORD}')) AS INTEGER) AS word_count FROM px"""))
def page_clean_text(spark, sf_dir):
    """P-12 + P-14 (+ W-13): cleaned main text and its word count per page."""
    x = extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return x.select("page_id", "content", web.word_count(F.col("content")).alias("word_count"))


@register("page_code_blocks", oracle(["fx_pages_code"], "WITH " + extraction_ctes("fx_pages_code") + """
SELECT page_id, content, CAST(length(content) - length(replace(content, '```', '')) AS INTEGER) / 6 AS code_blocks FROM px"""))
def page_code_blocks(spark, sf_dir):
    """P-13: code blocks protected during cleaning and restored as fenced blocks."""
    x = extract_pages(fixture(spark, sf_dir, "fx_pages_code").select("page_id", "html"))
    return x.select("page_id", "content", (web.count_substr(F.col("content"), "```") / 2).cast("int").alias("code_blocks"))


@register("page_nested_regions", oracle([], "WITH " + extraction_ctes("pages") + """
SELECT px.page_id, trim(CASE px.page_id % 5 WHEN 0 THEN concat('zq', px.page_id, ' ', content) WHEN 1 THEN concat('zq', px.page_id, ' ', content)
         WHEN 2 THEN concat('zq’s café — ', content) ELSE content END) AS content
FROM px JOIN pages p ON p.page_id = px.page_id WHERE contains(p.html, '<article>') AND contains(p.html, '</article>')"""))
def page_nested_regions(spark, sf_dir):
    """P-12: regions that hold elements of their own name, class regions, references
    of every kind, and dropped elements that are never closed."""
    mark = F.concat(F.lit("zq"), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 5
    opened = (F.when(kind == 0, F.concat(F.lit("<article><div class=toc><article>"), mark, F.lit("</article></div>")))
              .when(kind == 1, F.concat(F.lit('<section class="big content"><section><div>'), mark, F.lit("</div></section>")))
              .when(kind == 2, F.lit("<article><p>zq&#8217;s caf&eacute; &#x2014;</p>"))
              .when(kind == 3, F.lit("<article><div><aside>gone<p>too</div>"))
              .otherwise(F.lit("<div><nav>gone</div><article>")))
    closed = F.when(kind == 1, F.lit("</section>")).otherwise(F.lit("</article>"))
    pages = read_table(spark, sf_dir, "pages").where(
        F.col("html").contains("<article>") & F.col("html").contains("</article>"))
    nested = pages.select("page_id", F.replace(F.replace("html", F.lit("<article>"), opened), F.lit("</article>"),
                                               closed).alias("html"))
    return extract_pages(nested).select("page_id", "content")


@register("page_source_type", oracle(["fx_page_urls"], f"""
SELECT {_source_type_sql('url')} AS source_type, count(*) AS pages
FROM fx_page_urls GROUP BY 1"""))
def page_source_type(spark, sf_dir):
    """P-4 + A-8: source type from the URL authority, counted per type."""
    urls = fixture(spark, sf_dir, "fx_page_urls").withColumn("source_type", web.source_type("url"))
    return web.source_breakdown(urls, "source_type", "pages")


_RECORD_SQL = "WITH " + extraction_ctes("pages") + "," + scoring_ctes() + """
SELECT substr(md5(url), 1, 12) AS id, url, title, source_type, round(quality, 6) AS quality_score,
       round(coherence, 6) AS coherence_score, word_count
FROM sc WHERE word_count >= 50 AND quality >= 6.0"""


def _records(spark, sf_dir):
    return web.retrieval_records(scored_pages(spark, sf_dir))


@register("retrieval_records", oracle([], _RECORD_SQL))
def retrieval_records(spark, sf_dir):
    """P-6 + P-32: retrieval records (flattened) of pages passing F-1 / F-3."""
    rec = _records(spark, sf_dir)
    return rec.select("id", "url", "title", F.col("metadata.source_type").alias("source_type"),
                      F.round("metadata.quality_score", 6).alias("quality_score"),
                      F.round("metadata.coherence_score", 6).alias("coherence_score"),
                      F.col("metadata.word_count").alias("word_count"))


@register("retrieval_stats", oracle([], "WITH " + extraction_ctes("pages") + "," + scoring_ctes() + """
SELECT count(*) AS total_documents, round(avg(quality), 6) AS avg_quality_score,
       round(avg(coherence), 6) AS avg_coherence_score, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS total_words
FROM sc WHERE word_count >= 50 AND quality >= 6.0"""))
def retrieval_stats(spark, sf_dir):
    """A-7: documents, mean quality, mean coherence, total words of the records."""
    st = web.retrieval_stats(_records(spark, sf_dir))
    return st.select("total_documents", F.round("avg_quality_score", 6).alias("avg_quality_score"),
                     F.round("avg_coherence_score", 6).alias("avg_coherence_score"), "total_words")


@register("retrieval_written", ORACLES["retrieval_stats"])
def retrieval_written(spark, sf_dir):
    """A-7 in one pass: the statistics of the records, kept while they are written."""
    st = write_observed(_records(spark, sf_dir), fresh_path(spark, "records"), web.retrieval_stat_columns())
    return st.select("total_documents", F.round("avg_quality_score", 6).alias("avg_quality_score"),
                     F.round("avg_coherence_score", 6).alias("avg_coherence_score"), "total_words")


@register("web_corpus_topk", oracle([], "WITH " + extraction_ctes("pages") + "," + scoring_ctes() + """
SELECT substr(md5(url), 1, 12) AS id, url, title, source_type, round(quality, 6) AS quality_score,
       round(coherence, 6) AS coherence_score, word_count
FROM sc WHERE word_count >= 50 AND quality >= 6.0
ORDER BY quality DESC, url LIMIT 50"""))
def web_corpus_topk(spark, sf_dir):
    """Flagship: pages -> extract -> clean -> score -> filter -> top 50 records."""
    # the ranking uses quality only: take the top k first, score coherence for k rows
    top = web.rank_pages(quality_pages(spark, sf_dir), "url", k=web.MAX_PAGES)
    top = web.add_coherence(top).withColumn("source_type", web.source_type("url"))
    return web.retrieval_records(top).select(
        "id", "url", "title", F.col("metadata.source_type").alias("source_type"),
        F.round("metadata.quality_score", 6).alias("quality_score"),
        F.round("metadata.coherence_score", 6).alias("coherence_score"),
        F.col("metadata.word_count").alias("word_count"))


@register("url_frontier", oracle([], """
WITH cand AS (
  SELECT url, 0 AS origin, page_id AS pos FROM pages
  UNION ALL
  SELECT regexp_replace(url, '[?#].*$', '') AS url, 1 AS origin, page_id AS pos FROM pages),
firsts AS (SELECT url, origin, pos, row_number() OVER (PARTITION BY url ORDER BY origin, pos) AS rn FROM cand),
seen AS (SELECT DISTINCT url FROM pages WHERE contains(url, '/en/'))
SELECT f.url, f.origin, f.pos FROM firsts f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.url = f.url)"""))
def url_frontier(spark, sf_dir):
    """SET-2 + W-10 + J-4: all seed then searched URLs, first sighting, minus seen URLs."""
    pages = read_table(spark, sf_dir, "pages")
    seeds = pages.select("url", F.col("page_id").alias("pos"))
    found = pages.select(F.regexp_replace("url", r"[?#].*$", "").alias("url"), F.col("page_id").alias("pos"))
    seen = pages.where(F.col("url").contains("/en/")).select("url")  # English pages were scraped before
    return web.url_frontier(seeds, found, seen)
