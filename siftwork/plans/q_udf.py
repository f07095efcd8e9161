"""Queries for the Python-worker paths: model scoring (U-1) and HTML
extraction (U-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chat import DEFAULT_JUDGE_TOPIC, JUDGE_HEAD, JUDGE_MID, JUDGE_TAIL, judge_prompt
from ..operators import chat as C
from ..operators import judge as J
from ..operators.pages import extract_pages
from ..functions.chat import remove_prompt_echo
from ..operators.udf import (
    GENERATION_OPTIONS, JUDGE_OPTIONS, batch_generate, stub_generation_loader, stub_judge_loader,
)
from ..sources.tables import read_table
from .q_chat import _FLAT_SQL, _existing_ctes, _prompt_ctes, _specs, flat_conversations
from .q_pages import extraction_ctes
from .registry import oracle, register


def _lit(t: str) -> str:
    return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n")) + ")"


def _judge_prompt_sql(u: str, a: str) -> str:
    ha, hb = JUDGE_HEAD.split("{topic}")
    return (f"concat({_lit(ha)}, '{DEFAULT_JUDGE_TOPIC}', {_lit(hb)}, {u}, {_lit(JUDGE_MID)}, {a}, {_lit(JUDGE_TAIL)})")


_PAIRS_SQL = _FLAT_SQL.replace(
    "max(role) FILTER (WHERE idx % 2 = 0) AS ur",
    "max(text) FILTER (WHERE idx % 2 = 0) AS ut, max(role) FILTER (WHERE idx % 2 = 0) AS ur").replace(
    "max(role) FILTER (WHERE idx % 2 = 1) AS ar",
    "max(text) FILTER (WHERE idx % 2 = 1) AS atx, max(role) FILTER (WHERE idx % 2 = 1) AS ar")


@register("model_batch_stub", oracle([], _PAIRS_SQL + f""",
jp AS (SELECT pid AS entry_idx, {_judge_prompt_sql('ut', 'atx')} AS prompt FROM xp WHERE n = 2)
SELECT entry_idx,
  CASE WHEN substr(md5(prompt), 1, 1) = '0' THEN NULL ELSE
    'RELEVANCE: ' || CAST(length(prompt) % 10 AS VARCHAR) || chr(10) || 'ACCURACY: ' || CAST(length(prompt) % 7 + 3 AS VARCHAR)
    || chr(10) || 'OVERALL: ' || CAST(length(prompt) % 11 AS VARCHAR) || chr(10) || 'REASON: stub ' || substr(md5(prompt), 1, 6) END
    AS generated_text,
  CASE WHEN substr(md5(prompt), 1, 1) = '0' THEN 'stub failure' END AS error
FROM jp"""))
def model_batch_stub(spark, sf_dir):
    """U-1 + S-9: judge prompts for every stored pair, scored by a model
    loaded lazily per worker (here the deterministic stub loader)."""
    flat = flat_conversations(spark, sf_dir)
    pairs = C.flat_to_pairs(flat).where(F.col("n") == 2)
    prompts = pairs.select(F.col("pair_idx").alias("entry_idx"),
                           judge_prompt(F.col("user"), F.col("assistant")).alias("prompt"))
    out = batch_generate(prompts, stub_judge_loader, keys=("entry_idx",), options=JUDGE_OPTIONS,
                         model_name="stub-judge")
    return out.select("entry_idx", "generated_text", "error")


@register("html_tree_extract", oracle([], "WITH " + extraction_ctes("pages") + """
SELECT page_id, title, content FROM px"""))
def html_tree_extract(spark, sf_dir):
    """U-2: parser extraction of title and cleaned main text."""
    return extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "html"))


# One generation spec per document: its first word is the topic, its second
# word goes into the question template; 1-3 entries per spec, batches of 2.
_SPEC_DOCS = """
SELECT doc_id AS spec_id, split_part(text, ' ', 1) AS topic,
  concat('How do I {task} with ', split_part(text, ' ', 2), '?') AS input_template,
  'Here is how to {task}: {explanation}' AS output_template,
  MAPFN(['task'], ['a concrete programming task']) AS variable_descriptions,
  doc_id % 3 + 1 AS num_entries, 2 AS batch_size
FROM documents
"""


@register("generate_pairs_stub", oracle([], "WITH " + _prompt_ctes(_SPEC_DOCS) + "," + _existing_ctes() + """,
g AS (SELECT spec_id, entry_no, (entry_no - 1) // batch_size AS batch_id, md5(prompt) AS h FROM e),
pr AS (SELECT spec_id, entry_no, batch_id, 'How do I ' || substr(h, 1, 8) || '?' AS "user",
              'Use ' || substr(h, 9, 12) || ' carefully.' AS assistant FROM g WHERE substr(h, 1, 2) <> '00'),
hx AS (SELECT *, md5("user" || assistant) AS pair_hash FROM pr WHERE pair_hash NOT IN (SELECT pair_hash FROM ex_hash)),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_hash ORDER BY spec_id, batch_id, entry_no) AS rn FROM hx)
       WHERE rn = 1)
SELECT spec_id, entry_no, pair_hash, "user", assistant FROM uq"""))
def generate_pairs_stub(spark, sf_dir):
    """Pipeline A end to end: J-6 + P-27 prompts per spec, U-1 generation (stub
    loader, failing rows isolated), P-34 echo removal, P-10 / P-9 extraction,
    F-8, then P-7 + J-1 + W-5 + W-6 uniqueness against the stored pairs."""
    specs = _specs(spark, sf_dir, _SPEC_DOCS, "documents")
    prompts = C.expand_specs(specs)
    gen = batch_generate(prompts, stub_generation_loader, keys=("spec_id", "entry_no", "batch_id"),
                         options=GENERATION_OPTIONS, model_name="stub-generator")
    comp = gen.where(F.col("error").isNull()).select(
        F.col("spec_id").alias("prompt_id"), F.lit(1).alias("attempt"),
        F.struct("spec_id", "batch_id").alias("batch_id"), F.col("entry_no").alias("pos"),
        remove_prompt_echo("generated_text", "prompt").alias("generated_text"))
    uq = C.unique_pairs(C.extract_pairs(comp), C.existing_hashes(flat_conversations(spark, sf_dir)))
    return uq.select(F.col("prompt_id").alias("spec_id"), F.col("pos").alias("entry_no"), "pair_hash", "user", "assistant")


@register("judge_pipeline_stub", oracle([], _PAIRS_SQL + f""",
jp AS (SELECT pid AS entry_id, {_judge_prompt_sql('ut', 'atx')} AS prompt FROM xp WHERE n = 2),
sc AS (SELECT entry_id, CASE WHEN substr(md5(prompt), 1, 1) = '0' THEN 'stub failure' END AS error,
              greatest(1.0, least(10.0, CAST(length(prompt) % 11 AS DOUBLE))) AS ov FROM jp)
SELECT entry_id, CASE WHEN error IS NULL THEN ov END AS overall,
       error IS NULL AND ov >= 6.0 AS kept, error FROM sc"""))
def judge_pipeline_stub(spark, sf_dir):
    """Pipeline B end to end: P-35 + P-28 judge prompts for the stored pairs,
    U-1 scoring (stub judge, failed calls become error rows), P-29 / P-30
    parsing, F-9 keep decision."""
    flat = flat_conversations(spark, sf_dir)
    entries = C.nested_entries(C.flat_to_pairs(flat).where(F.col("n") == 2)).select(
        F.col("pair_idx").alias("entry_id"), "messages")
    m = F.col("messages")
    prompts = entries.select("entry_id", judge_prompt(m[0]["content"], m[1]["content"]).alias("prompt"))
    judged = batch_generate(prompts, stub_judge_loader, keys=("entry_id",), options=JUDGE_OPTIONS,
                            model_name="stub-judge").withColumnRenamed("generated_text", "evaluation_text")
    ev = J.evaluations(entries, judged)
    kept = F.col("error").isNull() & (F.col("scores.overall") >= J.MIN_SCORE)
    return ev.select("entry_id", F.col("scores.overall").alias("overall"), kept.alias("kept"), "error")
