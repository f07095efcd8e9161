"""Domain list operators (pipeline E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import clean_domain, is_topical, usable_domain
from .running import running_sum

ROWS_PER_REQUEST = 100


def cleaned_domains(rows: DataFrame, domain: str = "domain") -> DataFrame:
    """F-14 then P-3; keeps the raw row key."""
    return rows.where(usable_domain(domain)).withColumn("clean_domain", clean_domain(domain))


def nested_rows(pages: DataFrame, rows: str = "rows") -> DataFrame:
    """S-4: scan pages as the API returns them, ``rows[].row.domain``, one row each."""
    return pages.select(F.explode(rows).alias("r")).select(F.col("r.row_idx").alias("row_id"),
                                                           F.col("r.row.domain").alias("domain"))


def distinct_domains(cleaned: DataFrame) -> DataFrame:
    """A-13: the set of non-empty clean domains (partial distinct per task first)."""
    return cleaned.where(F.col("clean_domain") != "").select(F.col("clean_domain").alias("domain")).distinct()


def topical_urls(domains: DataFrame) -> DataFrame:
    """F-6 + W-11 + K-4 body: sorted https URLs of topical domains."""
    top = domains.where(is_topical("domain"))
    return top.select(F.concat(F.lit("https://"), F.col("domain")).alias("url"), "domain").orderBy("domain")


def write_url_list(urls: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-4 as a text dataset, one URL per line, globally sorted by domain."""
    urls.select("url").write.mode(mode).text(path)


def scan_progress(rows: DataFrame, row_key: str = "row_id", domain: str = "domain",
                  per_request: int = ROWS_PER_REQUEST) -> DataFrame:
    """A-19: after each request of ``per_request`` rows, rows processed so far and
    unique clean domains found so far.

    Unique-so-far counts each domain at the request where it is first seen
    (one groupBy on the domain), then running sums over requests.
    """
    req = F.floor(F.col(row_key) / per_request).cast("long")
    base = rows.select(req.alias("request"), F.when(usable_domain(domain), clean_domain(domain)).alias("d"))
    rows_per_req = base.groupBy("request").agg(F.count(F.lit(1)).alias("rows"))
    first_seen = (base.where(F.col("d").isNotNull() & (F.col("d") != ""))
                  .groupBy("d").agg(F.min("request").alias("request"))
                  .groupBy("request").agg(F.count(F.lit(1)).alias("new_domains")))
    per_req = rows_per_req.join(first_seen, "request", "left").fillna(0, ["new_domains"])
    cum = running_sum(per_req, "request", ["rows", "new_domains"])
    return cum.select("request", F.col("rows_cum").alias("rows_processed"),
                      F.col("new_domains_cum").alias("unique_domains"))
