"""Queries for repository trees, code cleaning/scoring and repository metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codescore import clean_code, code_coherence_score, code_quality_score, code_word_count
from ..functions.paths import repo_url_parts
from ..operators import repos as R
from ..functions.text import fence
from ..sources.fixtures import fixture
from .oracle_values import (
    BANNER_START, CODE_EXTENSIONS_BONUS, CODE_LINE_WORDS, CODE_STRUCTURE_WORDS, CODE_TECH_KEYWORDS, CONFIG_EXTENSIONS,
    CONFIG_FILES, DOCS_PATTERNS, LAYOUT_PATTERNS, SOURCE_EXTENSIONS, TEST_PATTERNS, UNWANTED_DIR_PATTERNS,
    UNWANTED_NAME_PATTERNS,
)
from .registry import DWS, oracle, register

FIRST_N = 20   # limit of the "first N files" query

# ---------------------------------------------------------------- oracle side


def _lit_list(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _strip(x):
    return f"regexp_replace({x}, '^{DWS}+|{DWS}+$', '', 'g')"


def path_info_ctes(src: str = "fx_paths") -> str:
    """CTEs ending in ``pinfo`` (tree rows with depth, extension, flags, unwanted)."""
    unwanted = " OR ".join([f"contains(lp, '{p}')" for p in UNWANTED_DIR_PATTERNS]
                           + [f"contains(lname, '{p}')" for p in UNWANTED_NAME_PATTERNS])
    return f"""
pa AS (SELECT owner, repo, pos, path, type, size, lower(path) AS lp,
         list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM {src}),
pb AS (SELECT *, coalesce(parts[-1], '') AS name,
         CAST(len(parts) - 1 + CASE WHEN starts_with(path, '/') THEN 1 ELSE 0 END AS INTEGER) AS depth FROM pa),
pc AS (SELECT *, lower(name) AS lname,
         CASE WHEN type = 'blob' THEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) END AS extension FROM pb),
pinfo AS (SELECT owner, repo, pos, path, type, size, depth, extension,
    (coalesce(extension IN ({_lit_list(CONFIG_EXTENSIONS)}), false) OR lname IN ({_lit_list(CONFIG_FILES)})
       OR contains(lp, 'config') OR contains(lp, 'settings')) AS is_config,
    coalesce(extension IN ({_lit_list(SOURCE_EXTENSIONS)}), false) AS is_source,
    regexp_matches(lp, '^(?:{'|'.join(TEST_PATTERNS)})') AS is_test,
    regexp_matches(lp, '^(?:{'|'.join(DOCS_PATTERNS)})') AS is_docs,
    ({unwanted}) AS is_unwanted
  FROM pc)
"""


def clean_ctes(src: str = "fx_code_files") -> str:
    """CTEs ending in ``cleaned(owner, repo, path, content)``: relational form of
    the banner / licence line rules (lines unnested, last event by window)."""
    return f"""
cl0 AS (SELECT owner, repo, path, string_split(content, chr(10)) AS ls FROM {src} WHERE content IS NOT NULL),
cl1 AS (SELECT owner, repo, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS idx FROM cl0),
cl2 AS (SELECT *, CASE WHEN contains(line, '{BANNER_START}') THEN 1 WHEN contains(line, '*/') THEN 2 ELSE 0 END AS ev,
               {_strip('line')} AS st FROM cl1),
cl3 AS (SELECT *, last_value(CASE WHEN ev > 0 THEN ev END IGNORE NULLS) OVER (
               PARTITION BY owner, repo, path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ev
        FROM cl2),
cleaned AS (SELECT owner, repo, path,
    coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (
      WHERE ev <> 1 AND coalesce(prev_ev, 0) <> 1
        AND NOT ((starts_with(st, '//') OR starts_with(st, '#'))
                 AND (contains(lower(st), 'copyright') OR contains(lower(st), 'license')))), '') AS content
  FROM cl3 GROUP BY owner, repo, path)
"""


def code_score_sql(c: str = "content", path: str = "path") -> tuple[str, str, str]:
    """(code_words, quality, coherence) expressions over a cleaned content column."""
    wc = f"len(regexp_extract_all({c}, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]{{3,}}'))"
    lc = f"lower({c})"
    ext = f"CASE WHEN contains({path}, '.') THEN lower(string_split({path}, '.')[-1]) ELSE '' END"
    kw = " + ".join(f"contains({lc}, '{k}')::INT" for k in CODE_TECH_KEYWORDS)
    struct = " OR ".join(f"contains({lc}, '{k}')" for k in CODE_STRUCTURE_WORDS)
    quality = f"""least(10.0, greatest(0.0, CAST(5.0 AS DOUBLE)
      + CASE WHEN {wc} BETWEEN 90 AND 5000 THEN 1.0 WHEN {wc} < 90 THEN -2.0 ELSE 0.0 END
      + CASE WHEN {ext} IN ({_lit_list(CODE_EXTENSIONS_BONUS)}) THEN 1.0 ELSE 0.0 END
      + CASE WHEN {struct} THEN 1.0 ELSE 0.0 END
      + least(({kw}) * CAST(0.3 AS DOUBLE), 1.5)
      + CASE WHEN (length({c}) - length(replace({c}, 'TODO', ''))) / 4 > {wc} * CAST(0.1 AS DOUBLE) THEN -0.5 ELSE 0.0 END))"""
    ls = f"string_split({c}, chr(10))"
    words = "|".join(CODE_LINE_WORDS)
    coherence = f"""least(10.0, greatest(0.0, CAST(5.0 AS DOUBLE)
      + CASE WHEN len(list_filter({ls}, lambda l: regexp_matches(l, '{words}'))) >= 2 THEN 1.0 ELSE 0.0 END
      + CASE WHEN len(list_filter({ls}, lambda l: starts_with(l, '  ') OR starts_with(l, chr(9))))
                  > len({ls}) * CAST(0.3 AS DOUBLE) THEN 0.5 ELSE 0.0 END
      + CASE WHEN len(list_filter({ls}, lambda l: starts_with({_strip('l')}, 'import') OR starts_with({_strip('l')}, 'from')
                  OR starts_with({_strip('l')}, '#include') OR starts_with({_strip('l')}, 'use '))) >= 1 THEN 0.5 ELSE 0.0 END))"""
    return wc, quality, coherence


def analysis_ctes(max_files: int | None = None, files_src: str = "fx_code_files") -> str:
    """CTEs ending in ``analysed``: accepted entries (F-5, F-2), optionally limited per repo (W-4)."""
    wc, _, _ = code_score_sql("c.content")
    return path_info_ctes() + "," + clean_ctes(files_src) + f""",
srcs AS (SELECT p.*, c.content, CAST({wc} AS INTEGER) AS code_words
         FROM pinfo p JOIN {files_src} f ON f.owner = p.owner AND f.repo = p.repo AND f.path = p.path
                      JOIN cleaned c ON c.owner = p.owner AND c.repo = p.repo AND c.path = p.path
         WHERE NOT p.is_unwanted AND p.is_source AND p.type = 'blob' AND f.content IS NOT NULL AND f.content <> ''),
acc AS (SELECT owner, repo, pos, path, type, size, depth, extension, is_config, is_source, is_test, is_docs,
               NULL::VARCHAR AS content, NULL::INTEGER AS code_words
        FROM pinfo WHERE NOT is_unwanted AND NOT (is_source AND type = 'blob')
        UNION ALL
        SELECT owner, repo, pos, path, type, size, depth, extension, is_config, is_source, is_test, is_docs, content, code_words
        FROM srcs WHERE code_words >= 90),
analysed AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY owner, repo ORDER BY pos) AS rn FROM acc) {f"WHERE rn <= {max_files}" if max_files else ""})
"""


def metrics_ctes() -> str:
    """CTE ``metrics`` over ``analysed`` (A-1, A-3..A-6)."""
    lay = " + ".join(f"max(CASE WHEN contains(path, '{p}') THEN 1 ELSE 0 END)" for p in LAYOUT_PATTERNS)
    return f"""
m0 AS (SELECT owner, repo, count(*) AS total_files_analyzed,
    count(*) FILTER (WHERE type = 'blob') AS total_files,
    count(*) FILTER (WHERE type = 'tree') AS total_directories,
    count(*) FILTER (WHERE is_source) AS source_files,
    count(*) FILTER (WHERE is_test) AS test_files,
    count(*) FILTER (WHERE is_config) AS config_files,
    count(*) FILTER (WHERE is_docs) AS documentation_files,
    coalesce(max(depth) FILTER (WHERE type = 'blob'), 0) AS maxd,
    coalesce(avg(depth) FILTER (WHERE type = 'blob'), 0.0) AS avgd,
    bool_or(contains(path, 'src/')) AS has_src,
    bool_or(contains(lower(path), 'component')) AS has_comp,
    bool_or(contains(lower(path), 'util') OR contains(lower(path), 'helper')) AS has_util,
    count(DISTINCT CASE WHEN contains(path, '/') THEN
       CASE WHEN starts_with(path, '/') THEN '/' ELSE list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.')[1] END END) AS tops,
    count(*) FILTER (WHERE type = 'blob' AND depth = 0) AS root_files,
    {lay} AS layout
  FROM analysed GROUP BY owner, repo),
m1 AS (SELECT *,
    greatest(0.0, least(10.0, CAST(10.0 AS DOUBLE)
      - CASE WHEN maxd > 8 THEN (maxd - 8) * CAST(0.5 AS DOUBLE) ELSE 0.0 END
      - CASE WHEN avgd > 4 THEN (avgd - 4) * CAST(0.3 AS DOUBLE) ELSE 0.0 END
      + CASE WHEN has_src THEN 0.5 ELSE 0.0 END + CASE WHEN has_comp THEN 0.5 ELSE 0.0 END
      + CASE WHEN has_util THEN 0.3 ELSE 0.0 END)) AS structure_score,
    CASE WHEN total_files = 0 THEN 0.0 ELSE CAST(least(10,
        CASE WHEN source_files / total_files > 0.3 THEN 3 WHEN source_files / total_files > 0.1 THEN 2
             WHEN source_files / total_files > 0 THEN 1 ELSE 0 END
      + CASE WHEN test_files / greatest(source_files, 1) > 0.5 THEN 3 WHEN test_files / greatest(source_files, 1) > 0.2 THEN 2
             WHEN test_files / greatest(source_files, 1) > 0 THEN 1 ELSE 0 END
      + CASE WHEN config_files > 0 THEN 2 ELSE 0 END + CASE WHEN documentation_files > 0 THEN 2 ELSE 0 END) AS DOUBLE) END AS completeness_score,
    greatest(0.0, least(10.0, CAST(5.0 AS DOUBLE) + CASE WHEN tops > 1 THEN 1.0 ELSE 0.0 END
      + least(3.0, layout * CAST(0.5 AS DOUBLE))
      - CASE WHEN root_files > 10 THEN (root_files - 10) * CAST(0.1 AS DOUBLE) ELSE 0.0 END)) AS organization_score
  FROM m0),
metrics AS (SELECT *, (structure_score + completeness_score + organization_score) / 3 AS overall_quality FROM m1)
"""


def runs_ctes(max_files: int | None = None) -> str:
    """CTE ``runs``: one row per requested URL with error or metrics."""
    return analysis_ctes(max_files) + "," + metrics_ctes() + f""",
u0 AS (SELECT url, pos, list_filter(string_split(regexp_replace(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1),
              '^/+|/+$', '', 'g'), '/'), lambda x: true) AS parts FROM fx_repo_urls),
u1 AS (SELECT url, pos, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner, CASE WHEN len(parts) >= 2 THEN parts[2] END AS repo,
              CASE WHEN len(parts) < 2 THEN 'Invalid GitHub URL format: ' || url END AS err FROM u0),
ex AS (SELECT DISTINCT owner, repo FROM fx_paths),
us AS (SELECT DISTINCT owner, repo FROM pinfo WHERE NOT is_unwanted),
runs AS (SELECT u1.url, u1.pos, u1.owner, u1.repo,
    coalesce(u1.err, CASE WHEN ex.owner IS NULL THEN 'Repository not found or not accessible' END,
             CASE WHEN us.owner IS NULL THEN 'Could not fetch repository files' END) AS error,
    coalesce(m.total_files_analyzed, 0) AS total_files_analyzed, coalesce(m.total_files, 0) AS total_files,
    coalesce(m.source_files, 0) AS source_files, coalesce(m.test_files, 0) AS test_files,
    coalesce(m.overall_quality, (CAST(10.0 AS DOUBLE) + 0.0 + 5.0) / 3) AS overall_quality
  FROM u1 LEFT JOIN ex ON ex.owner = u1.owner AND ex.repo = u1.repo
          LEFT JOIN us ON us.owner = u1.owner AND us.repo = u1.repo
          LEFT JOIN metrics m ON m.owner = u1.owner AND m.repo = u1.repo)
"""


# ----------------------------------------------------------------- spark side

def _paths(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_paths")


def _contents(spark, sf_dir, name="fx_code_files"):
    return fixture(spark, sf_dir, name)


def analysed(spark, sf_dir, max_files=None):
    return R.analyse_paths(_paths(spark, sf_dir), _contents(spark, sf_dir), max_files)


def runs(spark, sf_dir, max_files=None):
    urls = fixture(spark, sf_dir, "fx_repo_urls")
    return R.repo_runs(urls, _paths(spark, sf_dir), _contents(spark, sf_dir), max_files)


@register("tree_explode", oracle(["fx_paths"], "WITH " + path_info_ctes() + """
SELECT owner, repo, pos, path, type, CAST(coalesce(size, 0) AS BIGINT) AS size FROM pinfo WHERE NOT is_unwanted"""))
def tree_explode(spark, sf_dir):
    """Tree documents as an API would return them (JSON text per repository
    chunk of at most 1024 entries), parsed and exploded (S-3)."""
    p = _paths(spark, sf_dir)
    entry = F.struct("pos", "path", "type", "size")
    docs = (p.groupBy("owner", "repo", F.floor(F.col("pos") / 1024).alias("chunk"))
            .agg(F.to_json(F.collect_list(entry)).alias("tree_json")))
    schema = "array<struct<pos:bigint,path:string,type:string,size:bigint>>"
    trees = docs.select("owner", "repo", F.from_json("tree_json", schema).alias("tree"))
    return R.tree_rows(trees)


@register("path_features", oracle(["fx_paths"], "WITH " + path_info_ctes() + """
SELECT owner, repo, pos, depth, extension, is_config, is_source, is_test, is_docs, is_unwanted FROM pinfo"""))
def path_features(spark, sf_dir):
    """P-16 + P-17 + F-5: depth, extension, class flags and unwanted flag per tree entry."""
    from ..functions.paths import is_unwanted
    info = R.path_info(_paths(spark, sf_dir))
    return info.select("owner", "repo", "pos", "depth", "extension", "is_config", "is_source", "is_test",
                       "is_docs", is_unwanted("path").alias("is_unwanted"))


@register("code_clean", oracle(["fx_code_files"], "WITH " + clean_ctes() + """
SELECT owner, repo, path, md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS content_chars FROM cleaned"""))
def code_clean(spark, sf_dir):
    """P-15 (W-15): cleaned file content (hash, length) per file."""
    c = _contents(spark, sf_dir).withColumn("content", clean_code("content"))
    return c.select("owner", "repo", "path", F.md5("content").alias("content_md5"),
                    F.length("content").alias("content_chars"))


_WC, _Q, _C = code_score_sql()


@register("code_scores", oracle(["fx_code_files"], "WITH " + clean_ctes() + f"""
SELECT owner, repo, path, CAST({_WC} AS INTEGER) AS word_count, round({_Q}, 6) AS quality_score,
       round({_C}, 6) AS coherence_score FROM cleaned"""))
def code_scores(spark, sf_dir):
    """P-2 + P-20 + P-21: code words, quality and coherence of cleaned files."""
    c = _contents(spark, sf_dir).withColumn("content", clean_code("content"))
    c = fence(c.withColumn("word_count", code_word_count("content")))
    return c.select("owner", "repo", "path", "word_count",
                    F.round(code_quality_score("content", "path", "word_count"), 6).alias("quality_score"),
                    F.round(code_coherence_score("content"), 6).alias("coherence_score"))


_WC2, _Q2, _C2 = code_score_sql("content", "path")


_CORPUS_SQL = f"""
SELECT substr(md5(owner || '/' || repo || '/' || path), 1, 12) AS id, owner || '/' || repo AS repository,
       path AS file_path, md5(content) AS content_md5, code_words AS word_count,
       round({_Q2}, 6) AS quality_score, round({_C2}, 6) AS coherence_score, extension AS file_extension, depth
FROM analysed WHERE content IS NOT NULL"""


@register("code_corpus", oracle(["fx_paths", "fx_code_files"], "WITH " + analysis_ctes() + _CORPUS_SQL))
def code_corpus(spark, sf_dir):
    """F-5 + F-2 + P-6: code records of all accepted source files."""
    return _corpus(analysed(spark, sf_dir))


@register("code_corpus_first_n", oracle(["fx_paths", "fx_code_files"], "WITH " + analysis_ctes(FIRST_N) + _CORPUS_SQL))
def code_corpus_first_n(spark, sf_dir):
    """W-4: the same, of the first 20 accepted entries of each repository."""
    return _corpus(analysed(spark, sf_dir, FIRST_N))


def _corpus(entries):
    rec = R.code_records(entries)
    return rec.select("id", "repository", "file_path", F.md5("content").alias("content_md5"), "word_count",
                      F.round("quality_score", 6).alias("quality_score"),
                      F.round("coherence_score", 6).alias("coherence_score"), "file_extension", "depth")


_METRIC_COLS = ["total_files_analyzed", "total_files", "total_directories", "source_files", "test_files",
                "config_files", "documentation_files"]


@register("repo_metrics", oracle(["fx_paths", "fx_code_files"], "WITH " + analysis_ctes() + "," + metrics_ctes() + f"""
SELECT owner, repo, {', '.join(_METRIC_COLS)}, CAST(maxd AS INTEGER) AS max_depth, round(avgd, 6) AS avg_depth,
       round(structure_score, 6) AS structure_score, round(completeness_score, 6) AS completeness_score,
       round(organization_score, 6) AS organization_score, round(overall_quality, 6) AS overall_quality
FROM metrics"""))
def repo_metrics(spark, sf_dir):
    """A-1 + A-3..A-6: repository metrics over the analysed entries."""
    m = R.repo_metrics(analysed(spark, sf_dir))
    return m.select("owner", "repo", *_METRIC_COLS, "max_depth", F.round("avg_depth", 6).alias("avg_depth"),
                    *[F.round(c, 6).alias(c) for c in ("structure_score", "completeness_score",
                                                       "organization_score", "overall_quality")])


@register("repo_extensions", oracle(["fx_paths", "fx_code_files"], "WITH " + analysis_ctes() + """
SELECT owner, repo, extension, count(*) AS files FROM analysed
WHERE extension IS NOT NULL AND extension <> '' GROUP BY owner, repo, extension"""))
def repo_extensions(spark, sf_dir):
    """A-2: extension histogram per repository (exploded)."""
    return R.extension_histogram(analysed(spark, sf_dir))


@register("repo_extension_maps", oracle(["fx_paths", "fx_code_files"], "WITH " + analysis_ctes() + """,
h AS (SELECT owner, repo, extension, count(*) AS files FROM analysed
      WHERE extension IS NOT NULL AND extension <> '' GROUP BY owner, repo, extension)
SELECT owner, repo, string_agg(extension || '=' || files, ',' ORDER BY extension) AS extensions FROM h GROUP BY owner, repo"""))
def repo_extension_maps(spark, sf_dir):
    """A-2: the histogram as one map per repository (written out in order to compare)."""
    m = R.extension_maps(analysed(spark, sf_dir))
    pairs = F.array_sort(F.map_entries("file_extensions"))
    return m.select("owner", "repo", F.array_join(F.transform(
        pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("extensions"))


@register("tree_branch_fallback", oracle(["fx_paths"], """
WITH tb AS (SELECT owner, repo, b.branch, b.d AS default_branch, pos, path FROM fx_paths,
              (VALUES ('trunk', 'trunk'), ('dev', 'trunk'), ('main', 'trunk'), ('gone', 'trunk')) b(branch, d)
            WHERE NOT (b.branch = 'trunk' AND length(repo) % 2 = 0) AND NOT (b.branch = 'dev' AND length(owner) % 3 = 0)),
pr AS (SELECT *, CASE WHEN branch = default_branch THEN 0 WHEN branch = 'master' THEN 1 WHEN branch = 'develop' THEN 2
                      WHEN branch = 'dev' THEN 3 WHEN branch = 'main' THEN 4 END AS p FROM tb)
SELECT owner, repo, branch, pos, path FROM (
  SELECT *, min(p) OVER (PARTITION BY owner, repo) AS best FROM pr WHERE p IS NOT NULL) WHERE p = best"""))
def tree_branch_fallback(spark, sf_dir):
    """J-5, tree half: the default branch, else master, develop, dev, main."""
    branches = F.array(*[F.lit(b) for b in ("trunk", "dev", "main", "gone")])
    trees = _paths(spark, sf_dir).select("owner", "repo", "pos", "path", F.explode(branches).alias("branch"),
                                         F.lit("trunk").alias("default_branch"))
    trees = trees.where(~((F.col("branch") == "trunk") & (F.length("repo") % 2 == 0))
                        & ~((F.col("branch") == "dev") & (F.length("owner") % 3 == 0)))
    return R.resolve_tree(trees).select("owner", "repo", "branch", "pos", "path")


@register("repo_run_summary", oracle(["fx_paths", "fx_code_files", "fx_page_urls", "fx_repo_urls"], "WITH " + runs_ctes() + """
SELECT count(*) FILTER (WHERE error IS NULL) AS successful_repos, count(*) FILTER (WHERE error IS NOT NULL) AS failed_repos,
       CAST(coalesce(sum(total_files_analyzed) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_files_analyzed,
       CAST(0 AS BIGINT) AS repos_limit_reached
FROM runs"""))
def repo_run_summary(spark, sf_dir):
    """P-5 + F-13 + A-16: successful / failed analyses, files analysed, limits reached."""
    res, _ = runs(spark, sf_dir)
    return R.run_summary(res)


@register("repo_summary_table", oracle(["fx_paths", "fx_code_files", "fx_page_urls", "fx_repo_urls"], "WITH " + runs_ctes() + """
SELECT owner || '/' || repo AS repository, total_files AS files, source_files AS source, test_files AS tests,
       round(overall_quality, 6) AS quality, pos
FROM runs WHERE error IS NULL ORDER BY pos LIMIT 10"""))
def repo_summary_table(spark, sf_dir):
    """W-8: first 10 successful repositories in request order."""
    res, _ = runs(spark, sf_dir)
    t = R.summary_table(res)
    return t.withColumn("quality", F.round("quality", 6))


@register("repo_url_parse", oracle(["fx_page_urls"], """
WITH u0 AS (SELECT page_id, url, string_split(regexp_replace(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1),
              '^/+|/+$', '', 'g'), '/') AS parts FROM fx_page_urls)
SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner, CASE WHEN len(parts) >= 2 THEN parts[2] END AS repo,
       CASE WHEN len(parts) < 2 THEN 'Invalid GitHub URL format: ' || url END AS error FROM u0"""))
def repo_url_parse(spark, sf_dir):
    """P-5: owner / repo / error from repository URLs."""
    owner, repo, err = repo_url_parts("url")
    return fixture(spark, sf_dir, "fx_page_urls").select("page_id", owner.alias("owner"), repo.alias("repo"),
                                                         err.alias("error"))
