"""Streaming queries: each stages its input (derived from the driver tables)
as several files, runs a Structured Streaming job to completion and returns
the sink contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chat import pair_hash
from ..functions.domains import clean_domain, is_topical, usable_domain
from ..operators import chat as C
from ..operators import web
from ..operators.pages import extract_pages
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from ..streaming import stream as ST
from .q_chat import pairs, unique_ctes
from .q_domains import _CLEAN_SQL, _TOPICAL_SQL
from .q_pages import _RECORD_SQL
from .registry import oracle, register

#: A bounded state shows only over several micro-batches.
MICRO_BATCHES = 8


@register("stream_dedupe_append", oracle(["fx_domains"], "WITH " + _CLEAN_SQL + f""",
dd AS (SELECT DISTINCT clean_domain AS domain FROM cd WHERE clean_domain <> '')
SELECT 'https://' || domain AS url, domain FROM dd WHERE {_TOPICAL_SQL}"""))
def stream_dedupe_append(spark, sf_dir):
    """ST-1 + ST-2 + K-5: domains arrive as files; each clean domain is kept
    the first time it is seen and appended if topical."""
    run = ST.new_run_dir(spark, "domains")
    rows = fixture(spark, sf_dir, "fx_domains")
    ST.stage_files(rows, f"{run}/src", key="row_id")
    s = ST.read_files(ST.stream_session(spark), f"{run}/src", rows.schema)
    cleaned = s.where(usable_domain("domain")).select(clean_domain("domain").alias("domain")).where(F.col("domain") != "")
    firsts = ST.first_sightings(cleaned, ["domain"])
    out = firsts.where(is_topical("domain")).select(F.concat(F.lit("https://"), F.col("domain")).alias("url"), "domain")
    ST.append_to(out, f"{run}/sink", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/sink")


@register("stream_dedupe_bounded", oracle([], "SELECT event_id, event_type FROM events"))
def stream_dedupe_bounded(spark, sf_dir):
    """ST-1 with bounded state: every event arrives twice, the second time within
    the hour; first sightings are kept for as long as the watermark allows, and the
    stream has many micro-batches, so the state of earlier ones is removed."""
    return run_dedupe_bounded(spark, sf_dir)[0]


def run_dedupe_bounded(spark, sf_dir, micro_batches=MICRO_BATCHES):
    run = ST.new_run_dir(spark, "events")
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    again = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    both = ev.unionByName(again)
    width = spark.sparkContext.defaultParallelism
    ST.stage_files(both, f"{run}/src", key="ts", files=micro_batches * width)
    s = ST.read_files(ST.stream_session(spark), f"{run}/src", both.schema, files_per_trigger=width)
    firsts = ST.first_sightings(s, ["event_id"], event_time="ts", delay="2 hours")
    progress = ST.append_to(firsts.select("event_id", "event_type"), f"{run}/sink", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/sink"), progress


@register("stream_first_pairs", oracle(["fx_retries"], unique_ctes("fx_retries") + """
SELECT batch_id, attempt, pos, prompt_id, pair_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_hash ORDER BY batch_id, attempt, pos, prompt_id) AS rn FROM vp) WHERE rn = 1"""))
def stream_first_pairs(spark, sf_dir):
    """ST-1 in order: pairs arrive batch by batch, ten minutes each; of every pair the first in
    (batch, attempt, position) order is appended, and remembered for three hours."""
    return run_first_pairs(spark, sf_dir)[0]


def run_first_pairs(spark, sf_dir, micro_batches=MICRO_BATCHES, keep="3 HOURS"):
    run = ST.new_run_dir(spark, "pairs")
    made = C.valid_pairs(pairs(spark, sf_dir, "fx_retries")).select(
        "batch_id", "attempt", "pos", "prompt_id", pair_hash("user", "assistant").alias("pair_hash"),
        F.timestamp_seconds(1_700_000_000 + F.col("batch_id") * 600).alias("made_at"))
    ST.stage_files(made, f"{run}/src", key="batch_id", files=micro_batches)
    s = ST.read_files(ST.stream_session(spark), f"{run}/src", made.schema, files_per_trigger=1)
    firsts = ST.first_in_order(s, ["pair_hash"], ["batch_id", "attempt", "pos", "prompt_id"], "made_at", keep, late="0 seconds")
    progress = ST.append_to(firsts.drop("made_at"), f"{run}/sink", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/sink"), progress


@register("stream_progress", oracle(["fx_domains"], "WITH " + _CLEAN_SQL + """
SELECT (SELECT count(*) FROM fx_domains) AS rows_processed,
       (SELECT count(DISTINCT clean_domain) FROM cd WHERE clean_domain <> '') AS unique_domains"""))
def stream_progress(spark, sf_dir):
    """ST-3: running rows processed and unique domains over a file stream."""
    run = ST.new_run_dir(spark, "progress")
    rows = fixture(spark, sf_dir, "fx_domains")
    ST.stage_files(rows, f"{run}/src", key="row_id")
    s = ST.read_files(ST.stream_session(spark), f"{run}/src", rows.schema)
    keyed = s.select(F.when(usable_domain("domain"), clean_domain("domain")).alias("d"))
    ST.changes_to(ST.key_counts(keyed, "d"), f"{run}/sink", f"{run}/ckpt")
    counts = ST.latest(spark, f"{run}/sink", "d", "n")
    return counts.agg(F.sum("n").cast("long").alias("rows_processed"),
                      F.count_if(F.col("d").isNotNull() & (F.col("d") != "")).alias("unique_domains"))


@register("stream_web_corpus", oracle([], _RECORD_SQL))
def stream_web_corpus(spark, sf_dir):
    """ST-4: pages arrive as files; extract, score, filter and append records."""
    run = ST.new_run_dir(spark, "pages")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ST.stage_files(pages, f"{run}/src")
    s = ST.read_files(ST.stream_session(spark), f"{run}/src", pages.schema)
    kept = web.keep_quality_pages(web.score_pages(extract_pages(s), coherence=False))
    rec = web.retrieval_records(web.add_coherence(kept).withColumn("source_type", web.source_type("url")))
    flat = rec.select("id", "url", "title", F.col("metadata.source_type").alias("source_type"),
                      F.round("metadata.quality_score", 6).alias("quality_score"),
                      F.round("metadata.coherence_score", 6).alias("coherence_score"),
                      F.col("metadata.word_count").alias("word_count"))
    ST.append_to(flat, f"{run}/sink", f"{run}/ckpt")
    return spark.read.parquet(f"{run}/sink")
