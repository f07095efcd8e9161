"""Queries for the file corpus built from analysed repositories, plus the
search-result selections (repository search, Q&A search)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repos as R
from ..operators import search as S
from ..session import fresh_path
from ..sources.fixtures import fixture
from ..sources.io import write_observed
from ..sources.tables import read_table
from .q_repos import analysis_ctes, analysed, runs, runs_ctes
from .q_web import _KW_SQL
from .registry import DWORD, DWS, ORACLES, oracle, register

_FX = ["fx_paths", "fx_code_files"]
_FX_RUNS = ["fx_paths", "fx_code_files", "fx_page_urls", "fx_repo_urls"]
_W = r"[\pL\pN_]"

# ---------------------------------------------------------------- oracle side


def _priority_cte(src: str = "analysed", limit: int | None = None) -> str:
    return f"""
prio AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY owner, repo
              ORDER BY is_source DESC, coalesce(size, 0) > 100 DESC, depth ASC, pos ASC) AS priority
    FROM {src} WHERE type = 'blob' AND (is_source OR is_config OR extension IN ('.md', '.json', '.yml', '.yaml')))
  {f"WHERE priority <= {limit}" if limit else ""})
"""


def _branch_cte(src: str = "fx_code_files") -> str:
    return f"""
rb AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY owner, repo, path
              ORDER BY CASE branch WHEN 'main' THEN 1 ELSE 2 END) AS rn
    FROM {src} WHERE branch IN ('main', 'master')) WHERE rn = 1)
"""


def _file_score_ctes(src: str) -> str:
    """``fq`` over ``src(owner, repo, path, extension, is_source, raw)``: P-22/23/24."""
    react = " + ".join(f"contains(lc, '{p}')::INT" for p in ["import react", "usestate", "useeffect", "component", "props"])
    return f"""
fb AS (SELECT owner, repo, path, extension, is_source, raw, lower(raw) AS lc, lower(coalesce(extension, '')) AS e,
    len(regexp_extract_all(raw, '{DWORD}')) AS wc,
    len(regexp_extract_all(replace(raw, '.', ' '), '{DWORD}')) AS sw,
    length(raw) - length(replace(raw, '.', '')) AS dots,
    length(raw) - length(replace(raw, '!', '')) AS bangs
  FROM {src}),
ftoks AS (SELECT owner, repo, path, unnest(regexp_extract_all(lc, '{DWORD}')) AS tok FROM fb),
ffreq AS (SELECT owner, repo, path, tok FROM ftoks WHERE length(tok) > 4 GROUP BY owner, repo, path, tok HAVING count(*) >= 3),
frep AS (SELECT owner, repo, path, count(*) AS n FROM ffreq GROUP BY owner, repo, path),
fq AS (SELECT fb.owner, fb.repo, fb.path, CAST(wc AS INTEGER) AS word_count,
    least(10.0, least(10.0, greatest(0.0,
      CAST(5.0 AS DOUBLE)
      + CASE WHEN wc BETWEEN 100 AND 5000 THEN 1.0 WHEN wc < 100 THEN -2.0 ELSE 0.0 END
      + CASE WHEN length(fb.path) > 10 THEN 0.5 ELSE 0.0 END
      + CASE WHEN contains(raw, '```') OR contains(raw, '<code>') OR contains(lc, 'function') THEN 1.0 ELSE 0.0 END
      + least(({_KW_SQL}) * CAST(0.3 AS DOUBLE), 1.5)
      + CASE WHEN sw / (dots + 1) BETWEEN 10 AND 25 THEN 0.5 ELSE 0.0 END
      + CASE WHEN bangs > wc * CAST(0.05 AS DOUBLE) THEN -1.0 ELSE 0.0 END))
      + CASE WHEN is_source THEN 1.0 ELSE 0.0 END
      + CASE WHEN e IN ('.js', '.jsx', '.ts', '.tsx') THEN ({react}) * CAST(0.2 AS DOUBLE)
             + CASE WHEN contains(raw, 'export default') THEN 0.3 ELSE 0.0 END
             + CASE WHEN contains(raw, 'PropTypes') OR contains(raw, 'interface') THEN 0.5 ELSE 0.0 END
             ELSE 0.0 END) AS quality_score,
    least(10.0, greatest(0.0, CAST(5.0 AS DOUBLE)
      + CASE WHEN len(list_filter(string_split(raw, chr(10) || chr(10)),
                                  lambda p: regexp_matches(p, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]'))) >= 2 THEN 1.0 ELSE 0.0 END
      + CASE WHEN dots >= 3 THEN least(coalesce(frep.n, 0) * CAST(0.2 AS DOUBLE), 1.0) ELSE 0.0 END)) AS coherence_score,
    contains(raw, '//') OR contains(raw, '/*') AS has_comments,
    contains(raw, '/**') OR contains(raw, '@param') AS has_documentation,
    CASE WHEN e NOT IN ('.js', '.jsx', '.ts', '.tsx', '.py') THEN 0.0
         WHEN len(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]'))) = 0 THEN 0.0
         ELSE least(10.0,
           (len(regexp_extract_all(raw, 'function{DWS}+{_W}+|const{DWS}+{_W}+{DWS}*=.*=>')) * CAST(0.5 AS DOUBLE)
            + len(regexp_extract_all(raw, 'class{DWS}+{_W}+')) * CAST(1.0 AS DOUBLE)
            + len(list_filter(regexp_extract_all(raw, '{_W}+'), lambda t: t IN ('if', 'for', 'while', 'switch', 'try'))) * CAST(0.3 AS DOUBLE))
           / len(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]'))) * 100.0)
    END AS complexity_score
  FROM fb LEFT JOIN frep ON frep.owner = fb.owner AND frep.repo = fb.repo AND frep.path = fb.path)
"""


# ----------------------------------------------------------------- spark side

@register("priority_files", oracle(_FX, "WITH " + analysis_ctes() + "," + _priority_cte(limit=30) + """
SELECT owner, repo, path, priority FROM prio"""))
def priority_files(spark, sf_dir):
    """F-7 + W-3: per repository, the first 30 priority files in (source, size, depth, position) order."""
    return R.priority_files(analysed(spark, sf_dir), R.FIRST_PRIORITY_FILES).select("owner", "repo", "path", "priority")


@register("branch_fallback", oracle(["fx_paths", "fx_code_files", "fx_branch_files"], "WITH " + _branch_cte("fx_branch_files") + """
SELECT owner, repo, path, branch, md5(content) AS content_md5 FROM rb"""))
def branch_fallback(spark, sf_dir):
    """J-5 + S-6: file content from main, else master."""
    rb = R.resolve_branch(fixture(spark, sf_dir, "fx_branch_files"))
    return rb.select("owner", "repo", "path", "branch", F.md5("content").alias("content_md5"))


_FQ_COLS = ["word_count", "has_comments", "has_documentation"]


@register("file_quality", oracle(_FX, "WITH " + analysis_ctes() + "," + _branch_cte() + """,
fsrc AS (SELECT p.owner, p.repo, p.path, p.extension, p.is_source, rb.content AS raw
         FROM pinfo p JOIN rb ON rb.owner = p.owner AND rb.repo = p.repo AND rb.path = p.path
         WHERE rb.content IS NOT NULL AND rb.content <> '')""" + "," + _file_score_ctes("fsrc") + """
SELECT owner, repo, path, word_count, round(quality_score, 6) AS quality_score, round(coherence_score, 6) AS coherence_score,
       round(complexity_score, 6) AS complexity_score, has_comments, has_documentation FROM fq"""))
def file_quality(spark, sf_dir):
    """P-22 + P-23 + P-24: quality, coherence, complexity and flags of fetched files."""
    info = R.path_info(fixture(spark, sf_dir, "fx_paths"))
    sc = R.with_file_coherence(R.scored_files(info, fixture(spark, sf_dir, "fx_code_files")))
    return sc.select("owner", "repo", "path", *_FQ_COLS[:1],
                     *[F.round(c, 6).alias(c) for c in ("quality_score", "coherence_score", "complexity_score")],
                     *_FQ_COLS[1:])


def _records(spark, sf_dir):
    res, an = runs(spark, sf_dir)
    top = R.top_repos(res).select(*R.KEY)
    files = R.candidate_files(an.join(top, R.KEY, "left_semi"))
    return R.file_records(R.scored_files(files, fixture(spark, sf_dir, "fx_code_files")))


_RECORDS_SQL = "WITH " + runs_ctes() + """,
toprepos AS (SELECT owner, repo FROM runs WHERE error IS NULL AND overall_quality IS NOT NULL),
an2 AS (SELECT a.* FROM analysed a JOIN toprepos t ON t.owner = a.owner AND t.repo = a.repo),""" + _priority_cte("an2") + "," + _branch_cte() + """,
fsrc AS (SELECT p.owner, p.repo, p.path, p.extension, p.is_source, rb.content AS raw
         FROM prio p JOIN rb ON rb.owner = p.owner AND rb.repo = p.repo AND rb.path = p.path
         WHERE rb.content IS NOT NULL AND rb.content <> '')""" + "," + _file_score_ctes("fsrc") + """,
recs AS (SELECT fq.*, fsrc.raw FROM fq JOIN fsrc ON fsrc.owner = fq.owner AND fsrc.repo = fq.repo AND fsrc.path = fq.path
         WHERE quality_score >= 5.0 AND word_count >= 90)
"""


@register("file_records", oracle(_FX_RUNS, _RECORDS_SQL + """
SELECT substr(md5(owner || '/' || repo || '/' || path), 1, 12) AS id,
       'https://raw.githubusercontent.com/' || owner || '/' || repo || '/main/' || path AS url,
       repo || ' - ' || path AS title, owner || '/' || repo AS repository, md5(raw) AS content_md5,
       word_count, round(quality_score, 6) AS quality_score, round(coherence_score, 6) AS coherence_score,
       round(complexity_score, 6) AS complexity_score, has_comments, has_documentation
FROM recs"""))
def file_records(spark, sf_dir):
    """W-2 + J-2 + F-4 + P-8 + P-32: file records of the best repositories' priority files."""
    rec = _records(spark, sf_dir)
    m = "metadata."
    return rec.select("id", "url", "title", F.col(m + "repository").alias("repository"),
                      F.md5("content").alias("content_md5"), F.col(m + "word_count").alias("word_count"),
                      *[F.round(m + c, 6).alias(c) for c in ("quality_score", "coherence_score", "complexity_score")],
                      F.col(m + "has_comments").alias("has_comments"),
                      F.col(m + "has_documentation").alias("has_documentation"))


@register("file_stats", oracle(_FX_RUNS, _RECORDS_SQL + """
SELECT count(*) AS total_files, CAST(coalesce(sum(length(raw)), 0) AS BIGINT) AS total_characters,
       round(coalesce(avg(quality_score), 0.0), 6) AS avg_quality_score FROM recs"""))
def file_stats(spark, sf_dir):
    """A-9: files, characters and mean quality of the file records."""
    st = R.file_stats(_records(spark, sf_dir))
    return st.select("total_files", "total_characters", F.round("avg_quality_score", 6).alias("avg_quality_score"))


@register("files_written", ORACLES["file_stats"])
def files_written(spark, sf_dir):
    """A-9 in one pass: the statistics of the file records, kept while they are written."""
    st = write_observed(_records(spark, sf_dir), fresh_path(spark, "file-records"), R.file_stat_columns())
    return st.select("total_files", "total_characters", F.round("avg_quality_score", 6).alias("avg_quality_score"))


@register("topic_topn", oracle([], """
SELECT topic, c_custkey, stars, rnk FROM (
  SELECT c_mktsegment AS topic, c_custkey, c_acctbal AS stars,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rnk
  FROM customer WHERE c_acctbal > 500) WHERE rnk <= 25"""))
def topic_topn(spark, sf_dir):
    """S-7 + W-9: per topic, best 25 by stars above the minimum."""
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("topic"), "c_custkey", F.col("c_acctbal").alias("stars"))
    return S.top_per_topic(c, "topic", "stars", "c_custkey").select("topic", "c_custkey", "stars", "rnk")


@register("qa_select", oracle([], """
SELECT event_type, event_id, value, 'https://stackoverflow.com/questions/' || CAST(event_id AS VARCHAR) AS link
FROM events WHERE coalesce(value, 0) >= 5"""))
def qa_select(spark, sf_dir):
    """S-8 + F-10: items scoring 5 or more."""
    ev = read_table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    sel = S.qa_items(ev, "event_type", "value", "event_id")
    return sel.select("event_type", "event_id", "value",
                      F.concat(F.lit("https://stackoverflow.com/questions/"), F.col("event_id").cast("string")).alias("link"))
