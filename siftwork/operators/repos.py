"""Repository analysis and code corpus (pipeline D).

Shuffle plan at scale:
* contents are filtered by their own path and reduced to the wanted files before
  any of them moves, then resolved to one branch per file with a window keyed by
  the full file key (owner, repo, path): no hot key even if one repository holds
  a third of all files;
* all limits are parameters and off by default; a per-repository "first N" is
  ``row_number() <= N``, which Spark plans as a WindowGroupLimit: each map task
  keeps at most N rows per repository before the shuffle;
* per-repository metrics are partial aggregations over every entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codescore import (
    clean_code, code_coherence_score, code_quality_score, code_word_count, file_coherence, file_quality_from,
    file_quality_inputs,
)
from ..functions.paths import (
    LAYOUT_PATTERNS, is_config, is_docs, is_source, is_test, is_unwanted, path_depth, path_extension,
    repo_url_parts,
)
from ..functions.text import fence, md5_prefix
from ..functions.webscore import with_repeated_terms
from ..session import staged as stage

# Fixed values that must equal the reference defaults.
FIRST_FILES = 50            # limit of the "first N files" form
FIRST_PRIORITY_FILES = 30   # limit of the "first N priority files" form
MIN_SOURCE_WORDS = 90
MIN_FILE_QUALITY = 5.0
PRIORITY_EXTENSIONS = [".md", ".json", ".yml", ".yaml"]
FILE_BRANCHES = ["main", "master"]          # raw-file fetch order
TREE_BRANCHES = ["master", "develop", "dev", "main"]  # tried after the default branch

KEY = ["owner", "repo"]
FILE_KEY = ["owner", "repo", "path"]


# ------------------------------------------------------------------ sources

def tree_rows(trees: DataFrame) -> DataFrame:
    """S-3: tree documents ``(owner, repo, tree array<struct<pos,path,type,size>>)``
    -> one row per entry, missing size = 0, unwanted entries dropped."""
    ex = trees.select(*KEY, F.explode("tree").alias("t"))
    rows = ex.select(*KEY, F.col("t.pos").alias("pos"), F.col("t.path").alias("path"),
                     F.col("t.type").alias("type"), F.coalesce(F.col("t.size"), F.lit(0)).cast("long").alias("size"))
    return rows.where(~is_unwanted("path"))


def resolve_branch(contents: DataFrame, branches=FILE_BRANCHES) -> DataFrame:
    """J-5: per file, the content of the first branch in ``branches`` that has it."""
    prio = F.array_position(F.array(*[F.lit(b) for b in branches]), F.col("branch"))
    cand = contents.where(F.col("branch").isin(branches)).withColumn("_prio", prio)
    w = Window.partitionBy(*FILE_KEY).orderBy("_prio")
    return cand.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_prio")


def wanted_contents(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One branch of each wanted file.  The semi join and the branch window share
    their keys, so the contents of the wanted files move once and no others stay."""
    return resolve_branch(contents.join(wanted.select(*FILE_KEY), FILE_KEY, "left_semi"))


def resolve_tree(trees: DataFrame, default_branch: str = "default_branch", branches=TREE_BRANCHES) -> DataFrame:
    """J-5, tree half: per repository the tree of its default branch, else of the
    first of ``branches`` that has one.  Only branch names are ranked; the chosen
    (owner, repo, branch) is joined back to the entries."""
    prio = F.when(F.col("branch") == F.col(default_branch), F.lit(0)).otherwise(
        F.array_position(F.array(*[F.lit(b) for b in branches]), F.col("branch")))
    cand = trees.select(*KEY, "branch", prio.alias("_prio")).where(
        (F.col("branch") == F.col(default_branch)) | F.col("branch").isin(branches))
    best = cand.groupBy(*KEY).agg(F.min_by("branch", "_prio").alias("branch"))
    return trees.join(best, [*KEY, "branch"], "left_semi")


# ------------------------------------------------------------ path analysis

def path_info(paths: DataFrame) -> DataFrame:
    """P-16 + P-17: depth, extension and class flags of each tree entry."""
    ext = path_extension("path", "type")
    return paths.withColumns({
        "depth": path_depth("path"),
        "extension": ext,
    }).withColumns({
        "is_config": is_config("path", F.col("extension")),
        "is_source": is_source(F.col("extension")),
        "is_test": is_test("path"),
        "is_docs": is_docs("path"),
    })


def analyse_paths(paths: DataFrame, contents: DataFrame, max_files: int | None = None) -> DataFrame:
    """F-5, P-16/17, F-2 and W-4: the accepted entries of each repository, with
    ``max_files`` the first so many in tree order.  Source blobs carry ``content`` (cleaned),
    ``code_words``; other entries have nulls there.

    A source blob is accepted only if its content exists, is non-empty and has
    at least 90 code words after cleaning.
    """
    # S-3: a tree entry without a size counts as size 0
    info = path_info(paths.where(~is_unwanted("path")).withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long")))
    src = F.col("is_source") & (F.col("type") == "blob")
    others = info.where(~src).withColumns({"content": F.lit(None).cast("string"), "code_words": F.lit(None).cast("int")})
    own = contents.where(~is_unwanted("path") & is_source(path_extension("path", F.lit("blob"))))
    files = wanted_contents(own, info.where(src)).select(*FILE_KEY, F.col("content").alias("_raw"))
    sources = (info.where(src).join(files, FILE_KEY, "inner")
               .where(F.col("_raw").isNotNull() & (F.col("_raw") != ""))
               .withColumn("content", clean_code("_raw")).drop("_raw"))
    # fenced: the filter on the word count must not expand the cleaning again
    sources = fence(sources).withColumn("code_words", code_word_count("content"))
    sources = sources.where(F.col("code_words") >= MIN_SOURCE_WORDS)
    accepted = others.unionByName(sources)
    if max_files is not None:
        w = Window.partitionBy(*KEY).orderBy("pos")
        accepted = accepted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_files).drop("_rn")
    # fenced: downstream plans reuse this result several times; without the
    # fence the optimizer re-derives constraints over the whole cleaning chain
    return fence(accepted)


def code_records(analysed: DataFrame) -> DataFrame:
    """Flat code records of accepted source files (P-6, P-2, P-20, P-21)."""
    src = analysed.where(F.col("content").isNotNull())
    return src.select(
        md5_prefix(F.concat_ws("/", *FILE_KEY)).alias("id"),
        F.concat_ws("/", "owner", "repo").alias("repository"),
        F.col("path").alias("file_path"),
        "content",
        F.col("code_words").alias("word_count"),
        code_quality_score("content", "path", "code_words").alias("quality_score"),
        code_coherence_score("content").alias("coherence_score"),
        F.col("extension").alias("file_extension"),
        "depth",
        F.current_timestamp().alias("timestamp"),
    )


# ------------------------------------------------------------ repo metrics

def _first_component(path):
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.when(path.startswith("/"), F.lit("/")).otherwise(F.get(parts, 0))


def repo_metrics(analysed: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A-1, A-3, A-4, A-5, A-6 per repository (one aggregation)."""
    p = F.col("path")
    lp = F.lower(p)
    blob = F.col("type") == "blob"
    layout = [F.max(F.when(p.contains(pat), 1).otherwise(0)).alias(f"_lay{i}") for i, pat in enumerate(LAYOUT_PATTERNS)]
    agg = analysed.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_files_analyzed"),
        F.count_if(blob).alias("total_files"),
        F.count_if(F.col("type") == "tree").alias("total_directories"),
        F.count_if(F.col("is_source")).alias("source_files"),
        F.count_if(F.col("is_test")).alias("test_files"),
        F.count_if(F.col("is_config")).alias("config_files"),
        F.count_if(F.col("is_docs")).alias("documentation_files"),
        F.max(F.when(blob, F.col("depth"))).alias("_maxd"),
        F.avg(F.when(blob, F.col("depth"))).alias("_avgd"),
        F.bool_or(p.contains("src/")).alias("_src"),
        F.bool_or(lp.contains("component")).alias("_comp"),
        F.bool_or(lp.contains("util") | lp.contains("helper")).alias("_util"),
        F.count_distinct(F.when(p.contains("/"), _first_component(p))).alias("_tops"),
        F.count_if(blob & (F.col("depth") == 0)).alias("_root"),
        *layout,
    )
    if repos is not None:
        agg = repos.select(*KEY).join(agg, KEY, "left")
    counts = ["total_files_analyzed", "total_files", "total_directories", "source_files", "test_files",
              "config_files", "documentation_files", "_root", "_tops"] + [f"_lay{i}" for i in range(len(LAYOUT_PATTERNS))]
    agg = agg.fillna(0, counts).fillna(False, ["_src", "_comp", "_util"])
    maxd = F.coalesce(F.col("_maxd"), F.lit(0))
    avgd = F.coalesce(F.col("_avgd"), F.lit(0.0))
    structure = (F.lit(10.0)
                 - F.when(maxd > 8, (maxd - 8) * F.lit(0.5)).otherwise(F.lit(0.0))
                 - F.when(avgd > 4, (avgd - 4) * F.lit(0.3)).otherwise(F.lit(0.0))
                 + F.when(F.col("_src"), F.lit(0.5)).otherwise(F.lit(0.0))
                 + F.when(F.col("_comp"), F.lit(0.5)).otherwise(F.lit(0.0))
                 + F.when(F.col("_util"), F.lit(0.3)).otherwise(F.lit(0.0)))
    structure = F.greatest(F.lit(0.0), F.least(F.lit(10.0), structure))
    total, source, test = F.col("total_files"), F.col("source_files"), F.col("test_files")
    sr = source / total
    tr = test / F.greatest(source, F.lit(1))
    completeness = (F.when(sr > 0.3, 3).when(sr > 0.1, 2).when(sr > 0, 1).otherwise(0)
                    + F.when(tr > 0.5, 3).when(tr > 0.2, 2).when(tr > 0, 1).otherwise(0)
                    + F.when(F.col("config_files") > 0, 2).otherwise(0)
                    + F.when(F.col("documentation_files") > 0, 2).otherwise(0))
    completeness = F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(10), completeness).cast("double"))
    matches = sum((F.col(f"_lay{i}") for i in range(len(LAYOUT_PATTERNS))), F.lit(0))
    organization = (F.lit(5.0)
                    + F.when(F.col("_tops") > 1, F.lit(1.0)).otherwise(F.lit(0.0))
                    + F.least(F.lit(3.0), matches * F.lit(0.5))
                    - F.when(F.col("_root") > 10, (F.col("_root") - 10) * F.lit(0.1)).otherwise(F.lit(0.0)))
    organization = F.greatest(F.lit(0.0), F.least(F.lit(10.0), organization))
    out = agg.select(
        *KEY, "total_files_analyzed", "total_files", "total_directories", "source_files", "test_files",
        "config_files", "documentation_files", maxd.cast("int").alias("max_depth"), avgd.alias("avg_depth"),
        structure.alias("structure_score"), completeness.alias("completeness_score"),
        organization.alias("organization_score"),
    )
    return out.withColumn(
        "overall_quality",
        (F.col("structure_score") + F.col("completeness_score") + F.col("organization_score")) / 3,
    )


def extension_histogram(analysed: DataFrame) -> DataFrame:
    """A-2 exploded: (owner, repo, extension, files) for non-empty extensions."""
    ext = analysed.where(F.col("extension").isNotNull() & (F.col("extension") != ""))
    return ext.groupBy(*KEY, "extension").agg(F.count(F.lit(1)).alias("files"))


def extension_maps(analysed: DataFrame) -> DataFrame:
    """A-2 as ``map<string,long>`` per repository (two-level: counts first, so a
    repository contributes one small row per distinct extension)."""
    h = extension_histogram(analysed)
    return h.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("extension", "files"))).alias("file_extensions"))


def repo_runs(urls: DataFrame, paths: DataFrame, contents: DataFrame,
              max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """P-5 + S-3 + analysis per requested URL.

    Returns (results, analysed), both staged: results has one row per URL with ``error``
    (invalid URL / no repository files) or the metrics; F-13 keeps rows with
    a null error.
    """
    owner, repo, err = repo_url_parts("url")
    req = urls.select("url", "pos", owner.alias("owner"), repo.alias("repo"), err.alias("error"))
    # one pass over the tree: does the repository exist, and does it have wanted entries
    flags = stage(paths.groupBy(*KEY).agg(F.bool_or(~is_unwanted("path")).alias("_has")), "repo-flags")
    usable = flags.where(F.col("_has")).select(*KEY)
    # written once, without contents: the metrics and the file corpus both start from it
    analysed = stage(analyse_paths(paths.join(req.where("error IS NULL").select(*KEY).distinct(), KEY, "left_semi"),
                                   contents, max_files).drop("content"), "analysed")
    metrics = repo_metrics(analysed, usable)
    res = (req.join(flags, KEY, "left")
           .withColumn("error", F.coalesce(
               F.col("error"),
               F.when(F.col("_has").isNull(), F.lit("Repository not found or not accessible")),
               F.when(~F.col("_has"), F.lit("Could not fetch repository files"))))
           .drop("_has")
           .join(metrics, KEY, "left"))
    res = res.withColumn("files_limit_reached",
                         F.when(F.col("error").isNull(), F.lit(False) if max_files is None
                                else F.col("total_files_analyzed") >= max_files))
    return stage(res, "repo-runs"), analysed


def run_summary(results: DataFrame) -> DataFrame:
    """A-16: successful / failed runs, files analysed, limits reached."""
    ok = F.col("error").isNull()
    return results.agg(
        F.count_if(ok).alias("successful_repos"),
        F.count_if(~ok).alias("failed_repos"),
        F.coalesce(F.sum(F.when(ok, F.col("total_files_analyzed"))), F.lit(0)).cast("long").alias("total_files_analyzed"),
        F.count_if(ok & F.col("files_limit_reached")).alias("repos_limit_reached"),
    )


def summary_table(results: DataFrame, n: int = 10) -> DataFrame:
    """W-8: the first ``n`` successful repositories in request order."""
    ok = results.where(F.col("error").isNull()).orderBy("pos").limit(n)
    return ok.select(F.concat_ws("/", *KEY).alias("repository"), F.col("total_files").alias("files"),
                     F.col("source_files").alias("source"), F.col("test_files").alias("tests"),
                     F.col("overall_quality").alias("quality"), "pos")


# ------------------------------------------------------------ file corpus

def top_repos(results: DataFrame, max_repos: int | None = None) -> DataFrame:
    """F-13 + W-2: successful analyses; with ``max_repos`` the best so many by
    overall quality, request order breaking ties."""
    ok = results.where(F.col("error").isNull() & F.col("overall_quality").isNotNull())
    if max_repos is None:
        return ok
    return ok.orderBy(F.col("overall_quality").desc(), F.col("pos")).limit(max_repos)


def candidate_files(analysed: DataFrame) -> DataFrame:
    """F-7: blobs that are source, config or .md/.json/.yml/.yaml."""
    return analysed.where((F.col("type") == "blob") & (
        F.col("is_source") | F.col("is_config") | F.col("extension").isin(PRIORITY_EXTENSIONS)))


def priority_files(analysed: DataFrame, max_files_per_repo: int) -> DataFrame:
    """F-7 + W-3: candidate files ordered by (source desc, size > 100 desc, depth
    asc, tree position), the first ``max_files_per_repo`` of each repository."""
    cand = candidate_files(analysed)
    w = Window.partitionBy(*KEY).orderBy(F.col("is_source").desc(), (F.col("size") > 100).desc(),
                                         F.col("depth").asc(), F.col("pos").asc())
    return (cand.withColumn("priority", F.row_number().over(w))
            .where(F.col("priority") <= max_files_per_repo))


def scored_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """J-5 + J-2 + P-22/24: fetch each wanted file (main, then master) and
    score the raw content; files without content are dropped.  Per-row
    counters are staged once behind a fence, scores are arithmetic on them."""
    raw = wanted_contents(contents, files).select(*FILE_KEY, F.col("content").alias("raw_content"))
    j = files.drop("content").join(raw, FILE_KEY, "inner").where(
        F.col("raw_content").isNotNull() & (F.col("raw_content") != ""))
    staged = fence(j.withColumns(file_quality_inputs("raw_content", "path", "extension")))
    out = staged.withColumns(file_quality_from("raw_content", "extension", "is_source"))
    return out.drop(*[c for c in staged.columns if c.startswith("_")])


def with_file_coherence(scored: DataFrame) -> DataFrame:
    """P-23: no filter reads it, so it is computed for the files that are left."""
    out = with_repeated_terms(scored, "raw_content").withColumn(
        "coherence_score", file_coherence("raw_content", "repeated_terms"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def file_records(scored: DataFrame, min_quality: float = MIN_FILE_QUALITY, min_words: int = MIN_SOURCE_WORDS) -> DataFrame:
    """F-4 + P-6 + P-8 + P-32: nested file records of good files."""
    good = scored.where((F.col("quality_score") >= min_quality) & (F.col("word_count") >= min_words))
    return with_file_coherence(good).select(
        md5_prefix(F.concat_ws("/", *FILE_KEY)).alias("id"),
        F.concat(F.lit("https://raw.githubusercontent.com/"), F.col("owner"), F.lit("/"), F.col("repo"),
                 F.lit("/main/"), F.col("path")).alias("url"),
        F.concat(F.col("repo"), F.lit(" - "), F.col("path")).alias("title"),
        F.col("raw_content").alias("content"),
        F.struct(
            F.lit("github_file").alias("source_type"),
            F.concat_ws("/", *KEY).alias("repository"),
            F.col("path").alias("file_path"),
            F.col("extension").alias("file_extension"),
            F.col("size").alias("file_size"),
            F.col("is_source"), F.col("is_config"), F.col("depth"),
            F.col("quality_score"), F.col("coherence_score"), F.col("word_count"),
            F.col("complexity_score"), F.col("has_comments"), F.col("has_documentation"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        ).alias("metadata"),
    )


def file_stat_columns() -> list:
    """A-9: files, total characters, average quality (0 when there are none)."""
    return [
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("total_characters"),
        F.coalesce(F.avg("metadata.quality_score"), F.lit(0.0)).alias("avg_quality_score"),
    ]


def file_stats(records: DataFrame) -> DataFrame:
    """A-9 of stored records."""
    return records.agg(*file_stat_columns())

