"""Queries for the domain list (pipeline E) over the fx_domains rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import domains as dom
from ..session import fresh_path
from ..sources.fixtures import fixture
from .oracle_values import TOPICAL_KEYWORDS
from .registry import DWS, oracle, register

_CLEAN_SQL = f"""
c0 AS (SELECT row_id, domain,
    split_part(split_part(split_part(split_part(
      regexp_replace(regexp_replace(domain, '^https?://', ''), '^www\\.', ''), '/', 1), '?', 1), '#', 1), ':', 1) AS d0
  FROM fx_domains WHERE domain IS NOT NULL AND domain <> ''),
c1 AS (SELECT row_id, domain, regexp_replace(lower(d0), '^{DWS}+|{DWS}+$', '', 'g') AS d1 FROM c0),
cd AS (SELECT row_id, domain, CASE WHEN regexp_full_match(d1, '[a-z0-9.-]+\\.[a-z]{{2,}}') THEN d1 ELSE '' END AS clean_domain FROM c1)
"""
_TOPICAL_SQL = " OR ".join(f"contains(domain, '{k}')" for k in TOPICAL_KEYWORDS)


@register("domain_clean", oracle(["fx_domains"], "WITH " + _CLEAN_SQL + """
SELECT row_id, clean_domain FROM cd"""))
def domain_clean(spark, sf_dir):
    """F-14 + P-3: normalised domain of every usable raw domain value."""
    return dom.cleaned_domains(fixture(spark, sf_dir, "fx_domains")).select("row_id", "clean_domain")


@register("domain_topical_urls", oracle(["fx_domains"], "WITH " + _CLEAN_SQL + f""",
dd AS (SELECT DISTINCT clean_domain AS domain FROM cd WHERE clean_domain <> '')
SELECT 'https://' || domain AS url, domain FROM dd WHERE {_TOPICAL_SQL} ORDER BY domain"""))
def domain_topical_urls(spark, sf_dir):
    """A-13 + F-6 + W-11 + K-4: sorted https URLs of distinct topical domains."""
    cleaned = dom.cleaned_domains(fixture(spark, sf_dir, "fx_domains"))
    return dom.topical_urls(dom.distinct_domains(cleaned))


@register("domain_progress", oracle(["fx_domains"], "WITH " + _CLEAN_SQL + """,
r AS (SELECT CAST(floor(f.row_id / 100) AS BIGINT) AS request, cd.clean_domain AS d
      FROM fx_domains f LEFT JOIN cd ON cd.row_id = f.row_id),
per AS (SELECT request, count(*) AS n FROM r GROUP BY request),
firsts AS (SELECT d, min(request) AS request FROM r WHERE d IS NOT NULL AND d <> '' GROUP BY d),
newd AS (SELECT request, count(*) AS n FROM firsts GROUP BY request)
SELECT per.request,
  CAST(sum(per.n) OVER (ORDER BY per.request) AS BIGINT) AS rows_processed,
  CAST(sum(coalesce(newd.n, 0)) OVER (ORDER BY per.request) AS BIGINT) AS unique_domains
FROM per LEFT JOIN newd ON newd.request = per.request"""))
def domain_progress(spark, sf_dir):
    """S-4 + A-19: rows processed and unique domains after each request of 100 rows."""
    return dom.scan_progress(fixture(spark, sf_dir, "fx_domains"))


@register("domain_nested_rows", oracle(["fx_domains"], "SELECT row_id, domain FROM fx_domains"))
def domain_nested_rows(spark, sf_dir):
    """S-4: rows read back from scan pages in the API's nested JSON form."""
    rows = fixture(spark, sf_dir, "fx_domains")
    entry = F.struct(F.col("row_id").alias("row_idx"), F.struct("domain").alias("row"))
    pages = rows.groupBy(F.floor(F.col("row_id") / dom.ROWS_PER_REQUEST)).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("rows"))).alias("body")).select("body")
    schema = "rows array<struct<row_idx:bigint,row:struct<domain:string>>>"
    return dom.nested_rows(pages.select(F.from_json("body", schema)["rows"].alias("rows")))


@register("sink_url_text", oracle(["fx_domains"], "WITH " + _CLEAN_SQL + f""",
dd AS (SELECT DISTINCT clean_domain AS domain FROM cd WHERE clean_domain <> '')
SELECT 'https://' || domain AS value FROM dd WHERE {_TOPICAL_SQL}"""))
def sink_url_text(spark, sf_dir):
    """K-4: the topical URLs as a text dataset, one per line, read back."""
    path = fresh_path(spark, "url-text")
    cleaned = dom.cleaned_domains(fixture(spark, sf_dir, "fx_domains"))
    dom.write_url_list(dom.topical_urls(dom.distinct_domains(cleaned)), path)
    return spark.read.text(path)
